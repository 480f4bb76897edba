"""Small tables made on the driver, as local relations: the optimizer knows them and drops empty ones."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    arrays = [pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, schema, strict=True)]
    # one schema for all: nullable, so that unions with other tables keep theirs
    fields = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema])
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=schema.names), schema=fields)
