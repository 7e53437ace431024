"""op13: the nearest-neighbour query."""

from pyspark.sql import functions as F

from palimpsest.llm.common import read
from palimpsest.llm.neighbours import search

NAME = "op13_nearest_neighbours"


def query(spark, sf_dir, report=None):
    """The 20 nearest found of every twentieth vector among all others."""
    return search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, report=report)
