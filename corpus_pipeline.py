"""The corpus pipeline: stages over ``documents``, each one an operator of ``palimpsest.llm``.

A stage takes ``(spark, docs, sf_dir)`` and works on all rows that its predecessor kept. All but
the last return the columns of ``docs``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers

from palimpsest.llm import langid, q_langid, q_packing
from palimpsest.llm.common import read, written
from palimpsest.llm.exact_dedup import drop_copies
from palimpsest.llm.packing import pack
from palimpsest.llm.repeats import cut_repeats
from palimpsest.llm.simhash import drop_near_copies


def known_language(spark, docs, sf_dir):
    """Documents that have a language (learned from the labelled rows of ``docs``); null texts and texts without a letter go."""
    return langid.keep_known(docs, public_tokenizers.path(q_langid.VOCABULARY), q_langid.model_for(docs))


def without_copies(spark, docs, sf_dir):
    """Of equal texts the document with the largest id."""
    return drop_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """Of each SimHash class (3-word shingles, 2 bits) the document with the smallest id."""
    return drop_near_copies(docs, shingle=3, max_bits=2)


def without_repeats(spark, docs, sf_dir):
    """Documents without the passages of 100 bytes or more that occur earlier."""
    return cut_repeats(docs)


def packed(spark, docs, sf_dir):
    """The pieces of every document."""
    return pack(docs, public_tokenizers.path(q_packing.TOKENIZER))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("suffix_dedup", without_repeats),
    ("packing", packed),
]
#: Learned models and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over ``documents``, each one's rows written and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
