"""T2 against the standard library's parser, and its behaviour on hostile markup."""

import random
import time
from html import unescape
from html.parser import HTMLParser

import duckdb

from palimpsest import oracle
from palimpsest.functions.text import lower_html_text


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def expected(html):
    p = Text()
    p.feed(html.lower())
    p.close()
    return "".join(p.out)


def stripped(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(2)
    got = {r.i: r.x for r in df.select("i", lower_html_text("t").alias("x")).collect()}
    return [got[i] for i in range(len(texts))]


PAGES = [
    "<p>caf&eacute; &#233; &#x2014; &#x1F600; &hellip;</p>", "<b>a</b><i>b</i>", "x &amp;lt; y &amp;amp; &#38;lt;", "&zzz; &; &#; & <3",
    "<!-- <b> --><div a='>' b=\"<\">t</div>", "<!DOCTYPE html><style>p{}</style>q<script>var t='</p>';</script>r", "a < b and c > d", "",
    "&Uuml;ber &ANGST; &nbsp;|&copy;", "<a href=x title=\"a>b\">link</a>",
    "<br/><img src='x'/>end"]


def test_like_the_parser(spark):
    assert stripped(spark, PAGES) == [expected(p) for p in PAGES]


def test_references_decode_like_unescape(spark):
    rng = random.Random(1)
    parts = ["&amp;", "&lt;", "&#65;", "&#x42;", "&eacute;", "&thickapprox;", "x", "#38;", "&lbrace;", " ", "&frac12;"]
    texts = ["".join(rng.choice(parts) for _ in range(12)) for _ in range(200)]
    assert stripped(spark, texts) == [unescape(t) for t in texts]


def test_hostile_markup(spark):
    texts = ["<b " + "x" * 1_000_000, "<b" + "y" * 1_000_000, "<b " + "a='1' " * 60_000 + ">end", "<a " * 3000, "<a \"" + "q" * 500_000, "&" * 200_000,
             "&amp;" * 50_000]
    start = time.time()
    got = stripped(spark, texts)
    assert got[0] == texts[0] and got[1] == texts[1] and got[2] == "end" and got[6] == "&" * 50_000
    assert time.time() - start < 60


def test_the_oracle_says_the_same(spark):
    con = duckdb.connect()
    texts = [t.lower() for t in PAGES] + ["&#0; &#55296; &#1114112; &#x10ffff;"]
    for t, s in zip(texts, stripped(spark, texts)):
        assert con.execute(f"SELECT {oracle.strip_html_sql('t')} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] == s
