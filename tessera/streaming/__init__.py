"""Feeding a graph from streams of files: each micro-batch is one committed import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.api import Connection
from tessera.catalog import struct_of
from tessera.operators import mutations


def table_stream(connection: Connection, table: str, folder: str, checkpoint: str, edges: bool = False) -> StreamingQuery:
    """Parquet files with a type's columns, ids included, that arrive in ``folder`` become rows of the type.

    A batch that was committed but not marked done comes again after a failure;
    rows whose id the table holds already are left out, so no row is added twice.
    """
    spark: SparkSession = connection.graph.spark
    kind = (connection.graph.schema.edges if edges else connection.graph.schema.nodes)[table]

    def add(batch: DataFrame, _: int) -> None:
        def do(graph):
            have = (graph.edges if edges else graph.nodes)[table]
            fresh = batch.dropDuplicates([have.columns[0]]).join(have.select(have.columns[0]), have.columns[0], "left_anti")
            mutations.append_frame(graph, table, fresh, edges=edges)

        connection.change(do)

    rows = spark.readStream.schema(struct_of(kind)).parquet(folder)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
