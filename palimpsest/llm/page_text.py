"""Main text of HTML pages by a linear-chain conditional random field.

A page is its sequence of leaf blocks (``html_blocks``). Each block has features of
its ancestors (tags, class, id and role words, also joined with the innermost tag) and of its text
(length, links, punctuation, words of short blocks); neighbouring labels, main text or
not, interact. Weights maximise the regularised conditional likelihood of labelled
pages, computed by forward and backward passes in numpy, and the best label
sequence of a page is found by Viterbi.

Labelled pages: at most ``sample_rows`` distinct pages, drawn by a hash of key and page, give blocks with
labels from their semantic elements (inside ``article`` or ``main`` and not inside
navigation, notices and the like); laid out anew in common page layouts (``LAYOUT`` below),
they also teach class names and arrangements that the sample lacks.

Defined cases: a null or empty page, or one without visible text, has an empty text; broken
markup is read as far as it goes; rows repeated are read each; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import html as H
import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, record_batch, slices, spread
from palimpsest.llm.html_blocks import leaf_blocks

# Names that pages use for their parts.
MAIN_PARTS = ["article", "main", "div class=content", "div id=main-content", "div class=post-body", "div class=entry-content",
              "section class=article-body", "div class=story", "div id=article", "div role=main", "div class=text"]
BEFORE = ["nav", "header", "div class=menu", "ul class=navigation", "div id=header", "div class=topbar", "div class=breadcrumb",
          "div role=navigation", "div class=banner", "div class=cookie-notice", "div class=notice", "div id=cookie-banner",
          "form class=search", "div class=site-header", "div class=masthead", "div role=banner", "div class=alert"]
AFTER = ["footer", "aside", "div class=sidebar", "div id=footer", "div class=related", "section class=comments", "div id=comments",
         "div class=copyright", "div class=newsletter", "form class=subscribe", "div class=widget", "div role=complementary",
         "ol class=comment-list", "div class=social-share", "div class=site-footer", "div role=contentinfo", "div class=legal"]
INSIDE = ["div class=ad", "div class=advert", "aside class=promo", "div class=advertisement", "div class=share-buttons",
          "form class=signup", "div class=related-links", "section class=comments", "div class=comment", "div class=sponsored",
          "nav class=toc", "footer class=comments", "div class=reader-comments", "div class=notice", "aside"]
PHRASES = ["Subscribe to our newsletter", "We use cookies to improve your experience. Accept all cookies", "Share this article",
           "All rights reserved", "Home", "About us", "Contact", "Log in", "Search", "Advertisement", "Read more", "Related stories",
           "Leave a comment", "Great post, thanks!", "Privacy policy", "Terms of service", "Sign up", "Next page", "Menu",
           "I do not agree with this article at all, the author is wrong about the second point.", "Reply", "Copyright 2024"]
#: Elements and class words of what is not main text, for labelling.
NOT_MAIN = frozenset("t:nav t:header t:footer t:aside t:form t:button c:ad c:ads c:advert c:advertisement c:sidebar c:menu "
                     "c:comments c:comment c:cookie c:notice c:promo c:banner c:share c:related".split())
MAIN = frozenset(["t:article", "t:main"])


def features(block) -> list[str]:
    text, linked, inner, around = block
    words = text.lower().split(" ", 60)
    n, share = len(words), linked / max(1, len(text))
    out = ["bias", f"i:{inner}", f"n:{sum(n > x for x in (1, 3, 6, 12, 24, 48))}", f"l:{sum(share > x for x in (0, 0.3, 0.8))}"]
    out += around
    out += [f"{a}|{inner}" for a in around if a[0] == "c" or a in ("t:article", "t:main", "t:header", "t:footer")]
    if text[-1:] in ".!?…:;\"'”»":
        out.append("stop")
    if n <= 16:
        out += [f"w:{w.strip('.,!?')}" for w in words]
    return out


# ------------------------------------------------------------------ learning

def _wrap(part: str, inner: str) -> str:
    tag, _, attr = part.partition(" ")
    name, _, value = attr.partition("=")
    return f"<{tag}{f' {name}={chr(34)}{value}{chr(34)}' if attr else ''}>{inner}</{tag}>"


def labelled_layout(main: list[str], other: list[str], rng: random.Random) -> tuple[list, list[int]]:
    """A page made of the given texts in a random layout, as blocks and labels."""
    mark = "\x02"  # in front of main texts, taken out again after parsing
    esc = lambda t: H.escape(t, quote=False)

    def junk():
        texts = [rng.choice(other) if other and rng.random() < 0.5 else rng.choice(PHRASES) for _ in range(rng.randint(1, 4))]
        form = rng.randint(0, 3)
        if form == 0:
            return "<ul>" + "".join(f'<li><a href="/x">{esc(t)}</a></li>' for t in texts) + "</ul>"
        if form == 1:
            return esc(texts[0])
        if form == 2:
            return "".join(f"<p>{esc(t)}</p>" for t in texts)
        return f"<h3>{esc(texts[0])}</h3>" + "".join(f"<div><a href=/>{esc(t)}</a></div>" for t in texts[1:])

    body = []
    for i, text in enumerate(main):
        tag = "h1" if i == 0 else rng.choices(["p", "p", "p", "div", "blockquote", "li", "h2"])[0]
        text = mark + esc(text)
        if i and rng.random() < 0.1:
            text = f'<a href="/y">{text}</a>'
        body.append(f"<ul><li>{text}</li></ul>" if tag == "li" else f"<{tag}>{text}</{tag}>")
        if rng.random() < 0.15:
            body.append(_wrap(rng.choice(INSIDE), junk()))
    if rng.random() < 0.2:
        body[0] = f"<header>{body[0]}</header>"
    if rng.random() < 0.3:
        body.append(_wrap(rng.choice(INSIDE), junk()))
    page = [_wrap(rng.choice(BEFORE), junk()) for _ in range(rng.randint(0, 3))]
    content = _wrap(rng.choice(MAIN_PARTS), "".join(body))
    if rng.random() < 0.4:
        content = _wrap(rng.choice(["div class=container", "div id=wrapper", "main", "div class=page", "section"]), content)
    page += [content] + [_wrap(rng.choice(AFTER), junk()) for _ in range(rng.randint(0, 3))]
    blocks = leaf_blocks("<html><body>" + "".join(page) + "</body></html>")
    labels = [int(b[0].startswith(mark)) for b in blocks]
    return [(b[0].lstrip(mark), *b[1:]) for b in blocks], labels


def labelled_pages(pages: list[str], layouts: int = 4) -> list[tuple[list, list[int]]]:
    """Labelled sequences from sampled pages and their texts in other layouts."""
    rng, out, phrases = random.Random(11), [], ["An example headline", *PHRASES]
    texts = [([p + "." for p in phrases[:3]], phrases)]
    for page in pages:
        blocks = leaf_blocks(page)
        labels = [int(bool(b[3] & MAIN) and not b[3] & NOT_MAIN) for b in blocks]
        if 1 in labels:
            out.append((blocks, labels))
            main = [b[0] for b, y in zip(blocks, labels) if y][:40]
            texts.append((main, [b[0] for b, y in zip(blocks, labels) if not y] or phrases))
    for main, other in texts:
        out += [labelled_layout(main[:rng.randint(1, len(main))], other, rng) for _ in range(layouts)]
    return [(b, y) for b, y in out if b]


@dataclass
class Model:
    """Weights: feature -> (not main, main), and label to label."""

    weights: dict[str, tuple[float, float]]
    change: np.ndarray

    def label(self, blocks: list) -> list[int]:
        """The best label sequence (Viterbi; of equals, the one that is not main text)."""
        (c00, c01), (c10, c11) = self.change.tolist()
        back, a, b = [], 0.0, 0.0
        for i, block in enumerate(blocks):
            x = y = 0.0
            for f in features(block):
                w = self.weights.get(f)
                if w is not None:
                    x += w[0]
                    y += w[1]
            if i:
                from0, from1 = a + c01 < b + c11, a + c00 < b + c10
                back.append((int(from1), int(from0)))
                a, b = max(a + c00, b + c10) + x, max(a + c01, b + c11) + y
            else:
                a, b = x, y
        if not blocks:
            return []
        out = [int(b > a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]


def train(sequences: list[tuple[list, list[int]]], steps: int = 120, rate: float = 0.1, penalty: float = 1e-3) -> Model:
    """Adam on the penalised mean log-likelihood, all sequences at once."""
    names: dict[str, int] = {}
    n, longest = len(sequences), max(len(y) for _, y in sequences)
    row, col = [], []
    label, length = np.zeros((n, longest), np.int64), np.array([len(y) for _, y in sequences])
    for s, (blocks, y) in enumerate(sequences):
        label[s, :len(y)] = y
        for t, block in enumerate(blocks):
            for f in set(features(block)):
                row.append(s * longest + t)
                col.append(names.setdefault(f, len(names)))
    row, col = np.array(row), np.array(col)
    seen = np.bincount(col, minlength=len(names))
    keep = seen[col] >= 3
    row, col = row[keep], col[keep]
    inside = np.arange(longest)[None, :] < length[:, None]
    gold = np.zeros((n, longest, 2))
    gold[np.arange(n)[:, None], np.arange(longest)[None, :], label] = inside
    pair_gold = np.einsum("sti,stj->ij", gold[:, :-1], gold[:, 1:])
    w, c = np.zeros((len(names), 2)), np.zeros((2, 2))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, c)]
    last = length - 1
    for step in range(1, steps + 1):
        score = np.stack([np.bincount(row, w[col, k], n * longest) for k in (0, 1)], 1).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = score[:, 0]
        for t in range(1, longest):
            alpha[:, t] = np.logaddexp(alpha[:, t - 1, :1] + c[0], alpha[:, t - 1, 1:] + c[1]) + score[:, t]
        for t in range(longest - 2, -1, -1):
            after = beta[:, t + 1] + score[:, t + 1]
            step_back = np.logaddexp(c[:, 0] + after[:, :1], c[:, 1] + after[:, 1:])
            beta[:, t] = np.where((t < last)[:, None], step_back, 0.0)
        total = np.logaddexp(*alpha[np.arange(n), last].T)
        node = np.exp(alpha + beta - total[:, None, None]) * inside[:, :, None]
        pair = np.zeros((2, 2))
        both = (inside[:, 1:])[:, :, None, None]
        joint = alpha[:, :-1, :, None] + c + (score + beta)[:, 1:, None, :] - total[:, None, None, None]
        pair = (np.exp(np.where(both, joint, -np.inf))).sum((0, 1))
        diff = (node - gold).reshape(-1, 2)
        grad_w = np.stack([np.bincount(col, diff[row, k], len(names)) for k in (0, 1)], 1) / n + penalty * w
        grad_c = (pair - pair_gold) / n + penalty * c
        for value, grad, (m, v) in zip((w, c), (grad_w, grad_c), state):
            m += 0.1 * (grad - m)
            v += 0.02 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.98 ** step)) + 1e-8)
    return Model({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items() if seen[i] >= 3}, c)


def drawn(pages: DataFrame, key: str = "page_id", html: str = "html", sample_rows: int = 150,
          max_bytes: int = 200_000) -> DataFrame:
    """``k, h``: of the distinct rows of at most ``max_bytes`` the ``sample_rows`` with the least
    hash of key and page, or all if there are fewer."""
    usable = pages.where(F.octet_length(html) <= max_bytes).select(
        F.col(key).alias("k"), F.col(html).alias("h"), F.xxhash64(key, html).alias("x"))
    least = usable.select(F.col("x").alias("d")).distinct().orderBy("d").limit(sample_rows)
    return usable.join(F.broadcast(least), F.col("x") == F.col("d")).groupBy("x").agg(
        F.min(F.struct("k", "h")).alias("page")).select("page.*")


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample_rows: int = 150,
        max_bytes: int = 200_000) -> Model:
    """The model from ``sample_rows`` pages of at most ``max_bytes``."""
    rows = drawn(pages, key, html, sample_rows, max_bytes).collect()  # bounded by the two parameters
    return train(labelled_pages([r["h"] for r in sorted(rows, key=lambda r: (str(r["k"]), r["h"]))]))


# ---------------------------------------------------------------- extraction

def main_text(html: str | None, model: Model) -> str:
    blocks = leaf_blocks(html)
    return " ".join(b[0] for b, y in zip(blocks, model.label(blocks)) if y)


def _extract(model):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "h"):
                texts = [main_text(h, model.value) for h in part.column("h").to_pylist()]
                yield record_batch({"k": part.column("k"), "u": part.column("u"), "text": pa.array(texts, pa.string()),
                                    "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return run


def extract(pages: DataFrame, model: Model, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` for every row."""
    rows = spread(pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h")))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    return map_batches(rows, _extract(shared), f"k {rows.schema['k'].dataType.simpleString()}, u string, text string, n_chars long"
                       ).withColumnsRenamed({"k": key, "u": url})
