"""op3: the toxicity query."""

from pyspark.sql import functions as F

from palimpsest.llm import toxicity
from palimpsest.llm.common import read

NAME = "op3_toxicity"


def query(spark, sf_dir):
    """The toxicity of every document, learned from the labels of rows not held out."""
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
