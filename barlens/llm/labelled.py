"""Samples of labelled documents, alike at every size of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a row is kept from all learning; a row without doc_id is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, rows: int, columns: list[str]) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, with ``y`` and ``half`` (0 or 1).

    The sample is the labels smallest in a hash of doc_id.  Labels of one document that
    contradict each other, and null labels, are left out.  The chosen labels are broadcast: they
    are at most ``rows`` rows of two numbers.
    """
    chosen = (labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)).groupBy(F.col("doc_id").cast("long").alias("_label_of"))
              .agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("_y2")).where("y = _y2").select("_label_of", "y")
              .orderBy(F.xxhash64("_label_of", F.lit(11)), "_label_of").limit(rows))
    return docs.select("doc_id", *columns).join(F.broadcast(chosen), docs["doc_id"].cast("long") == F.col("_label_of")) \
        .select(*columns, "y", F.pmod(F.xxhash64("_label_of", F.lit(13)), F.lit(2)).cast("int").alias("half"))
