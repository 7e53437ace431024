"""op4: the segmentation sampling query."""

import public_tokenizers
from pyspark.sql import functions as F

from palimpsest.llm.common import read
from palimpsest.llm.sampling import sample_segmentations

NAME = "op4_sentencepiece_sampling"
MODEL = "piece_bpe_32k.model"


def query(spark, sf_dir):
    """Two distinct segmentations of every document."""
    out = sample_segmentations(read(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))
    return out.select("doc_id", "draw", "n_pieces", "ids_crc32", F.round("log_prob", 6).alias("log_prob"),
                      F.round("perturbed", 6).alias("perturbed"), F.round("log_inclusion", 6).alias("log_inclusion"), "decodes")
