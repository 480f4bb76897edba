"""Shared plumbing of the training-data operators.

Every operator takes any DataFrame, picks the id and text columns it is told
to use and returns only columns of its own, so extra input columns (whatever
their names) never clash.  A null text counts as an empty text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Python workers get batches of at most this many bytes and rows, whatever the text lengths are.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000

#: The ASCII white space that ends a word in the operators' contracts.
SPACE = "\x20\x09-\x0d"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch holds, so that very long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def picked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id as a long and the text, null as empty."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[list], list[tuple]]],
    schema: str,
) -> DataFrame:
    """Runs ``make()`` once a task; what it returns maps a list of texts to one row of values each.

    ``docs`` has ``doc_id``, ``text`` and any further columns; the result has all but ``text``, and the columns of ``schema``.
    """
    bound_batches(docs.sparkSession)
    kept = [k for k, c in enumerate(docs.columns) if c != "text"]
    at = docs.columns.index("text")
    parts = [part.split(maxsplit=1) for part in schema.split(", ")]
    names = [docs.columns[k] for k in kept] + [name for name, _ in parts]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[kind] for _, kind in parts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = work(batch.column(at).to_pylist())
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in kept), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
                names=names,
            )

    fields = T.StructType([docs.schema[k] for k in kept])
    for name, kind in parts:
        fields.add(name, T._parse_datatype_string(kind))
    return docs.mapInArrow(run, fields)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what the cluster names; one of our own only where all tasks run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Cuts lineage with a table written to the shared folder (in place of what an unfinished run left at ``path``); a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = path or f"{scratch_dir(spark)}/tessera-{re.sub(r'[^a-z0-9]', '', tag)}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def discard(df: DataFrame) -> None:
    """Deletes a table written by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A side of a join with at most this many (narrow) rows is broadcast.
BROADCAST_ROWS = 1 << 20
#: A key with more than this share of all rows is heavy; there are at most 1000 such keys.
HEAVY_SHARE = 1000


def sized_join(large: DataFrame, small: DataFrame, on: Column | list[Column], how: str) -> DataFrame:
    """A join whose right side, a settled table of ids and hashes, is broadcast if a count of its rows allows it, else shuffled."""
    return large.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, on, how)


def spread_join(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, a settled one with one row a key and ``n``, the key's count among ``rows``.

    Rows of heavy keys meet a broadcast table of at most HEAVY_SHARE rows, so that no task gets all rows of a key.
    """
    heavy = F.broadcast(table.where(F.col("n") * HEAVY_SHARE > total))
    light = rows.join(heavy.select(key), key, "left_anti").join(table.where(F.col("n") * HEAVY_SHARE <= total), key)
    return light.unionByName(rows.join(heavy, key))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and mark, a hash of the text; id and mark tell rows apart that are no repeats."""
    return picked(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def first_row() -> Column:
    """Of a group: ids before none, the least id, the least mark."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))


def without_copies(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each group; its columns as they were.

    ``rows`` has (doc_id, mark, first) for each row of ``docs``: first is the row (no_id, doc_id, mark) that stays of
    its group.  Rows go by id and mark together, so a row never goes for another one with its id; of rows that
    repeat both one stays.
    """
    same = (F.col("mark") == F.col("first.mark")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    losers = materialize(rows.where(~same).select("doc_id", "mark").distinct(), "losers")
    repeated = materialize(rows.where(same).groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark"), "repeated")
    names = docs.columns
    text = F.coalesce(F.col(f"c{names.index(text_col)}").cast("string"), F.lit(""))
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))]).withColumns({"_id": F.col(f"c{names.index(id_col)}").cast("long"), "_mark": F.xxhash64(text)})
    at = lambda t: [F.col("_mark") == t["mark"], F.col("_id").eqNullSafe(t["doc_id"])]
    kept = sized_join(plain, losers, at(losers), "left_anti")
    if not repeated.isEmpty():
        once = sized_join(kept, repeated, at(repeated), "left_semi").dropDuplicates(["_id", "_mark"])
        kept = sized_join(kept, repeated, at(repeated), "left_anti").unionByName(once)
    return kept.drop("_id", "_mark").toDF(*names)
