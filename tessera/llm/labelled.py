"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, picked

#: Labels may have at most this many different grades.
MAX_GRADES = 32


def held_out(id_column: Column) -> Column:
    """The fixed fold that no model here learns labels from."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, grade) of labelled rows outside the held-out fold, and the count of labelled ids by grade.

    The ids of a grade come in order of a hash of the id: at most ``per_class`` of them, and
    only as long as the texts before hold fewer than ``chars`` characters.  So a grade sends
    at most ``chars`` characters and one text to the driver, and whether a text is in does not
    depend on its own length.  An id with several texts gives one of them, an id with several
    labels counts with the highest; null labels and ids and negative grades do not count.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("grade"))
        .where("doc_id is not null and grade >= 0")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("grade").alias("grade"))
    )
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().limit(MAX_GRADES + 1).collect()}
    if len(counts) > MAX_GRADES:
        raise ValueError(f"more than {MAX_GRADES} grades in {label}")
    ids: list[tuple[int, int]] = []
    for grade in sorted(counts):
        first = known.where(F.col("grade") == grade).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids += [(r["doc_id"], r["grade"]) for r in first.select("doc_id", "grade").collect()]
    if not ids:
        return [], counts
    spark = docs.sparkSession
    chosen = spark.createDataFrame(ids, "doc_id long, grade int")
    rows = picked(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")  # at most MAX_GRADES * per_class small rows
    sample = materialize(rows.groupBy("doc_id").agg(F.first("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
    sizes = {r[0]: r[1] for r in sample.select("doc_id", F.length("text")).collect()}
    held = dict.fromkeys(counts, 0)
    kept = []
    for doc_id, grade in ids:
        if doc_id in sizes and held[grade] < chars:
            held[grade] += sizes[doc_id]
            kept.append((doc_id,))
    if not kept:
        return [], counts
    found = sample.join(F.broadcast(spark.createDataFrame(kept, "doc_id long")), "doc_id").select("doc_id", "text", "grade").collect()
    discard(sample)
    return [(r["text"], r["grade"]) for r in sorted(found)], counts
