"""V1: word n-grams as array expressions.

Built with ``zip_with`` over shifted slices of the token array. Every n-gram
level references ``tokens`` more than once, so the optimizer keeps the token
array as its own projection instead of inlining the regex chain into a lambda
(indexing a computed array inside ``transform(sequence(..))`` re-evaluates it
per element).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_ngram_range(value) -> tuple[int, int]:
    """Accept ``(min, max)`` or ``"min,max"``; fall back to (1, 2) on bad text."""
    if isinstance(value, str):
        try:
            lo, hi = (int(v) for v in value.split(","))
        except ValueError:
            return (1, 2)
    else:
        lo, hi = value
    if lo < 1 or hi < lo:
        raise ValueError(f"invalid ngram_range {(lo, hi)}")
    return (int(lo), int(hi))


def vectorizer_tokens(tokens: Column) -> Column:
    """Tokens the vectorizer keeps: two or more word characters."""
    return F.filter(tokens, lambda x: F.length(x) >= 2)


def word_ngrams(tokens: Column, ngram_range=(1, 2)) -> Column:
    """All n-grams with min <= n <= max, each joined by one space.

    Order: all unigrams, then all bigrams, ... (as a bag; order is irrelevant
    to the term counts built from it).
    """
    lo, hi = parse_ngram_range(ngram_range)
    size = F.size(tokens)
    levels = []
    gram = tokens
    for n in range(1, hi + 1):
        if n > 1:
            shifted = F.slice(tokens, n, size)
            gram = F.zip_with(gram, shifted, lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= lo:
            levels.append(gram if n == 1 else F.filter(gram, lambda x: x.isNotNull()))
    return levels[0] if len(levels) == 1 else F.concat(*levels)
