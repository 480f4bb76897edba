"""Mixing sources to target weights by capped water-filling.

Targets.  Sources share all words by weight; none may pass ``max_epochs`` times
its own words, and the excess of capped sources is shared among the others by
weight until none is above.  With sources in order of cap / weight, the capped
ones are a prefix, so prefix sums give the settled water level in one pass over
one row a source (a sort of them in one task: about 50 bytes a source).

Sampling.  A source with r = target / words repeats every document floor(r)
times, and a sample of the share r - floor(r) once more.  The sample is
systematic: documents are dealt by a seeded hash of id and text into buckets of
about ``bucket_rows``, ordered by size within each, and every 1/share-th is taken.
(Only rows that repeat both id and text share a hash.)
Each bucket tries 40 seeded offsets and takes the one whose words come nearest,
so that a few long documents do not move a source off its target.  A hot source
only has more buckets.  All steps are DataFrame functions; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize

#: Weights of the sources in order of name (code points, null last), repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_ROWS = 512
OFFSETS = 40
SEED = 42


def unit(key):
    """A seeded number in [0, 1) for a string, the same in any engine with MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *others: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long").alias("size"),
        F.md5(text).alias("mark"),
        *others,
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, n_docs, source_size, target) of each source of (source, size)."""
    whole = Window.partitionBy()
    table = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    table = table.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(max_epochs))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum(
        "weight"
    ).over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    table = table.withColumn("level", level)
    # the level rises as capped sources leave and falls once an uncapped one does: its highest value is the settled one
    settled = F.max("level").over(whole)
    return table.withColumn("settled", settled).select(
        "source", "n_docs", "source_size", F.least("cap", F.col("settled") * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each row: doc_id, source, size (words), source_size, target (its source's words), copies, taken (copies * size).

    Null texts have size 0; a null source is a source of its own, last in order.
    Repeated rows count and are sampled like any.  Where all sizes are 0 all
    targets are 0 and every document is copied 0 times.  An empty table gives an
    empty result.
    """
    return decided(materialize(sized(docs, id_col, text_col, source_col), "sizes"), weights, max_epochs, seed, bucket_rows).drop("mark")


def decided(sizes: DataFrame, weights, max_epochs: int, seed: int, bucket_rows: int) -> DataFrame:
    """The columns of ``sizes`` (doc_id, source, size, mark and any others), source_size, target, copies and taken."""
    table = (
        targets(sizes, weights, max_epochs)
        .withColumn("ratio", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0))
        .withColumn("buckets", F.ceil(F.col("n_docs") / bucket_rows).cast("long"))
        .withColumnRenamed("source", "_source")
    )
    rows = sizes.join(table, sizes["source"].eqNullSafe(table["_source"]))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("mark"))
    rows = rows.select(
        *[sizes[c] for c in sizes.columns],
        "source_size",
        "target",
        F.floor("ratio").cast("long").alias("whole"),
        (F.col("ratio") - F.floor("ratio")).alias("share"),
        F.md5(key).alias("key"),
        F.floor(unit(key) * F.col("buckets")).cast("long").alias("bucket"),
    )
    bucket = Window.partitionBy("source", "bucket")
    rows = rows.withColumn("rank", F.row_number().over(bucket.orderBy("size", "key")).cast("double"))
    label = F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("bucket").cast("string"))
    rows = rows.withColumn("start", unit(label))
    picks = []
    for k in range(OFFSETS):
        u = (F.col("start") + k / OFFSETS) - F.floor(F.col("start") + k / OFFSETS)
        picks.append((F.floor(F.col("rank") * F.col("share") + u) > F.floor((F.col("rank") - 1) * F.col("share") + u)).cast("long"))
    rows = rows.withColumn("picks", F.array(*picks))
    total = F.sum("size").over(bucket).cast("double") * F.col("share")
    misses = [F.abs(F.sum(F.col("size") * F.col("picks")[k]).over(bucket) - total) for k in range(OFFSETS)]
    rows = rows.withColumn("misses", F.array(*misses))
    best = F.element_at("picks", F.array_position("misses", F.array_min("misses")).cast("int"))
    return rows.withColumn("copies", F.col("whole") + best).select(
        *sizes.columns, "source_size", F.round("target", 6).alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


ADDED = ["size", "source_size", "target", "copies", "taken"]


def mixed(
    docs: DataFrame,
    weights=WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    bucket_rows: int = BUCKET_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with the columns of ``mix`` beside its own: how often each row, with its text, goes into the corpus.

    A column of ``docs`` that has the name of an added one is renamed ``docs_`` and that name.  Rows are numbered in a settled
    copy, so repeated rows and ids keep their own counts.  Nulls and empty tables as for ``mix``.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumn("row", F.monotonically_increasing_id())
    plain = materialize(plain, "numbered")
    at = {c: f"c{names.index(c)}" for c in (id_col, text_col, source_col)}
    sizes = sized(plain.withColumn("_row", F.col("row")), at[id_col], at[text_col], at[source_col], "_row")
    found = decided(materialize(sizes, "sizes"), weights, max_epochs, seed, bucket_rows).select(F.col("_row").alias("row"), *ADDED)
    shown = [F.col(f"c{k}").alias(f"docs_{c}" if c in ADDED else c) for k, c in enumerate(names)]
    return plain.join(found, "row").select(*shown, *ADDED)


def oracle() -> str:
    """The same by window functions in DuckDB."""
    unit_sql = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
    key = f"'{SEED}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || mark"
    start = unit_sql.format(f"concat_ws(':', '{SEED}', coalesce(source, ''), bucket::VARCHAR)")
    shift = lambda k: f"(start + {k / OFFSETS}::DOUBLE) - floor(start + {k / OFFSETS}::DOUBLE)"
    picks = ", ".join(
        f"(floor(rank * share + ({shift(k)})) > floor((rank - 1) * share + ({shift(k)})))::BIGINT AS p{k}" for k in range(OFFSETS)
    )
    misses = ", ".join(f"abs(sum(size * p{k}) OVER b - sum(size) OVER b * share) AS m{k}" for k in range(OFFSETS))
    listed = lambda c: "[" + ", ".join(f"{c}{k}" for k in range(OFFSETS)) + "]"
    weight = f"CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(WEIGHTS)} " + " ".join(
        f"WHEN {k} THEN {float(w)}::DOUBLE" for k, w in enumerate(WEIGHTS)
    ) + " END"
    return rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents
), s1 AS (
  SELECT source, count(*) AS n_docs, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), s2 AS (
  SELECT *, {weight} AS weight, source_size * {float(MAX_EPOCHS)}::DOUBLE AS cap FROM s1
), s3 AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2
), s4 AS (
  SELECT *, least(cap, weight * max(level) OVER ()) AS target FROM s3
), s5 AS (
  SELECT source AS src, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {float(MAX_EPOCHS)}::DOUBLE) ELSE 0 END AS ratio,
    ceil(n_docs / {float(BUCKET_ROWS)}::DOUBLE) AS buckets FROM s4
), r1 AS (
  SELECT doc_id, source, size, source_size, target, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS share, md5({key}) AS key,
    floor({unit_sql.format(key)} * buckets)::BIGINT AS bucket
  FROM sizes JOIN s5 ON source IS NOT DISTINCT FROM src
), r2 AS (
  SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY size, key)::DOUBLE AS rank, {start} AS start FROM r1
), r3 AS (
  SELECT *, {picks} FROM r2
), r4 AS (
  SELECT *, {misses} FROM r3 WINDOW b AS (PARTITION BY source, bucket)
), r5 AS (
  SELECT *, whole + {listed('p')}[list_position({listed('m')}, list_min({listed('m')}))] AS copies FROM r4
)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM r5
"""
