"""Bounded samples of labelled documents, for classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, need

#: At most so many labelled rows are learned from, each of at most so many characters; the driver gets 48 MB at most.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 16384


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> list[tuple[bytes, int]]:
    """(text, label) of a bounded sample of labelled rows outside the held-out fold, those with the least hash of doc_id.

    Null ids, texts and labels are left out. A doc_id with several labels counts with each.
    """
    known = need(labels, "doc_id", label).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(2 * rows)
    texts = need(docs, "doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", label, "text").limit(rows)
    return [(r["text"].encode(), int(r[label])) for r in found.collect()]
