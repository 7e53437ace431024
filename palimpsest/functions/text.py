"""Text scalar functions as Spark Column expressions.

Everything here is a built-in expression (regexp_replace, split, filter,
zip_with, ...), so it stays inside whole-stage codegen on the JVM and each
pattern string is also valid RE2 for the DuckDB oracle queries.

Character classes follow Python's ``str`` semantics, which is what the
reference's ``re`` calls operate on:

* Python ``\\w`` on str = letters, numbers and underscore -> ``\\p{L}\\p{N}_``
  (Java's ``\\w`` is ASCII only, so it is never used).
* Python whitespace (``str.split()``/``str.strip()``/``\\s``) =
  ``\\t\\n\\x0b\\x0c\\r``, ``\\x1c-\\x1f``, ``\\x85`` and every ``\\p{Z}`` char.
  Java ``\\s`` lacks the Unicode part and RE2 ``\\s`` lacks ``\\x0b``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's whitespace set, spelled for both Java regex and RE2.
WS = r"\t\n\x0b\x0c\r\x1c-\x1f\x85\p{Z}"
WS_RUN = f"[{WS}]+"
# Anything that is neither a Python word character nor whitespace.
NON_WORD_NON_SPACE = rf"[^\p{{L}}\p{{N}}_{WS}]"
DIGIT_RUN = r"\p{Nd}+"
# A maximal run of word characters that are not decimal digits: exactly the
# tokens left by punctuation -> space, digit runs -> space, whitespace split.
WORD_RUN = r"[\p{L}\p{Nl}\p{No}_]+"
# Pieces of the word tokenizer: words with apostrophes and full stops inside, dots in a row, dashes, and
# any other character by itself.
_WORD = r"[\p{L}\p{N}_]"
WORD_PIECES = rf"{_WORD}++(?:['.]{_WORD}++)*+|\.\.\.|--|[^\p{{L}}\p{{N}}_{WS}]"
# Clitics split from the end of a word, and words that are two (as the Penn Treebank splits them).
CLITICS = ("s", "m", "d", "ll", "re", "ve")
CONTRACTIONS = (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("more", "'n"),
                ("wan", "na"))
# The places inside a piece (pieces stand between single spaces) where it is split, as one alternation.
WORD_SPLITS = "|".join((r"(?<=[^ ])(?=n't(?: |\z))", rf"(?<=[^ ])(?='(?:{'|'.join(CLITICS)})(?: |\z))",
                        *(rf"(?<=(?:^| ){a})(?={b}(?: |\z))" for a, b in CONTRACTIONS)))
# Leading or trailing whitespace (Python str.strip()).
STRIP_EDGES = rf"^[{WS}]+|[{WS}]+\z"

# The minimal English stop-word set the reference falls back to
# when the NLTK list is unavailable (27 words, in the reference's order).
MINIMAL_STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else",
    "when", "at", "from", "by", "for", "with", "about", "to", "in",
    "on", "it", "is", "are", "was", "were", "be", "been", "being",
)

# Character references: decimal, hexadecimal and named (names as the HTML 5 standard
# has them, in lower case since the text is lower-cased first; from the standard library).
ENTITY = r"&(?:#[0-9]{1,7}|#x[0-9a-f]{1,6}|[a-z][a-z0-9]{0,31});"


def named_entities() -> dict[str, str]:
    """Lower-case named references (``&amp;`` ...) and their characters."""
    from html.entities import html5

    return {f"&{name}": char for name, char in sorted(html5.items()) if name.endswith(";") and name == name.lower()}


# What is markup, as one alternation read from left to right, so that a tag inside a comment or a
# comment inside a script is part of it. A comment or raw-text element that is never closed reaches
# to the end. Possessive where a step can't be undone to any use: an unclosed tag costs one scan and no stack.
HTML_MARKUP = "|".join((
    r"<!--(?:-?>|[\s\S]*?(?:--!?>|\z))",
    *(rf"<{name}(?:[\s/][^>]*+)?+>[\s\S]*?(?:</{name}[^>]*+>|\z)" for name in ("script", "style", "template")),
    r"<[!?][^>]*+>",
    r"""</?[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_html(text: Column | str) -> Column:
    """Markup to text, like ``get_text()`` of an HTML parser.

    No separator is inserted where tags were (``<p>a</p><p>b</p>`` -> ``ab``);
    comments, declarations and script/style/template bodies are dropped in one pass;
    character references are decoded on the JVM, each once. Expects lower-cased input
    for the tag patterns (the preprocessing lower-cases first).
    """
    return decode_entities(F.regexp_replace(_col(text), HTML_MARKUP, ""))


def decode_entities(text: Column) -> Column:
    """Character references to characters; unknown ones stay as they are.

    The text is split at the references and put together again, so what a
    reference decodes to is never decoded a second time. The names are one constant: a JSON
    text that the optimizer folds into a map."""
    names = F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")

    def decoded(ref: Column) -> Column:
        body = F.substring(ref, 3, F.length(ref) - 3)
        code = F.when(F.startswith(body, F.lit("x")), F.conv(F.substring(body, 2, 6), 16, 10)).otherwise(body).cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(F.startswith(ref, F.lit("&#")), F.when(valid, char).otherwise(F.lit("\ufffd"))).otherwise(
            F.coalesce(F.try_element_at(names, ref), ref))

    def together(t: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), 0), decoded)
        parts = F.zip_with(F.split(t, ENTITY), refs, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    # bound to a name, so that the markup pass behind ``text`` runs once
    return F.get(F.transform(F.array(text), together), 0)


def maybe_strip_html(text: Column) -> Column:
    """``strip_html`` applied only to rows that can hold markup or entities
    (containing ``<`` or ``&``); other rows pass through unchanged."""
    return F.when(F.contains(text, F.lit("<")) | F.contains(text, F.lit("&")),
                  strip_html(text)).otherwise(text)


def normalize(text: Column | str, html: bool = True) -> Column:
    """Lower-case, strip markup, punctuation -> space, digit runs -> space."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    if html:
        t = maybe_strip_html(t)
    t = F.regexp_replace(t, NON_WORD_NON_SPACE, " ")
    return F.regexp_replace(t, DIGIT_RUN, " ")


def lower_html_text(html: Column | str) -> Column:
    """T1 + T2: the lower-cased visible text of an HTML string."""
    return maybe_strip_html(F.lower(F.coalesce(_col(html), F.lit(""))))


def word_tokens(text: Column | str, html: bool = True) -> Column:
    """T1-T5 in one regex pass: lower-case, strip markup, then every maximal
    run of non-digit word characters. Same tokens as
    ``tokenize(normalize(text))`` (which replaces punctuation and digit runs
    by spaces and splits at whitespace), without building the rewritten
    string."""
    t = F.lower(F.coalesce(_col(text), F.lit("")))
    if html:
        t = maybe_strip_html(t)
    return word_runs(t)


def word_runs(text: Column | str) -> Column:
    """The maximal runs of non-digit word characters of a text that is lower-cased and stripped already."""
    return F.regexp_extract_all(_col(text), F.lit(WORD_RUN), 0)


def tokenize(normalized: Column | str) -> Column:
    """T5: whitespace split (Python ``str.split()``), empty pieces dropped."""
    return F.filter(F.split(_col(normalized), WS_RUN), lambda x: x != F.lit(""))


def split_words(text: Column | str) -> Column:
    """T5 with the word tokenizer's splits: the tokens of a lower-cased text, punctuation included.

    ``don't`` gives ``do n't``, ``it's`` gives ``it 's``, ``cannot`` gives ``can not``. Null and blank texts have none."""
    pieces = F.array_join(F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(WORD_PIECES), 0), " ")
    return F.filter(F.split(F.regexp_replace(pieces, WORD_SPLITS, " "), " "), lambda x: x != F.lit(""))


def remove_stopwords(tokens: Column | str, stopwords=MINIMAL_STOPWORDS) -> Column:
    """Drop tokens found in the stop-word list."""
    return F.filter(_col(tokens), lambda x: x.isNotNull() & ~x.isin(*stopwords))  # one look-up in a set, not a walk along the list


def join_tokens(tokens: Column | str) -> Column:
    """Tokens joined by one space = ``processed_text``."""
    return F.array_join(_col(tokens), " ")


def is_blank(text: Column | str) -> Column:
    """Text that is empty after Python-style whitespace stripping."""
    return F.regexp_replace(F.coalesce(_col(text), F.lit("")), STRIP_EDGES, "") == F.lit("")


def py_strip(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(_col(text), STRIP_EDGES, "")


def preview(text: Column | str, style: str = "always", width: int = 100) -> Column:
    """First ``width`` characters plus ``...``.

    ``always`` appends the ellipsis unconditionally (TF-IDF chunk mode);
    ``if_truncated`` only when the text is longer than ``width`` (dense mode).
    """
    t = _col(text)
    head = F.concat(F.substring(t, 1, width), F.lit("..."))
    if style == "always":
        return head
    if style == "if_truncated":
        return F.when(F.length(t) > width, head).otherwise(t)
    raise ValueError(f"unknown preview style {style!r}")
