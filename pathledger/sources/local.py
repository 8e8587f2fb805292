"""Small driver-side rows as relations whose size Spark knows."""

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_ARROW = {
    T.StringType: pa.string(),
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.BooleanType: pa.bool_(),
}


def local_frame(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType) -> DataFrame:
    """A relation from rows already on the driver.

    Passed as Arrow it stays a local relation with exact statistics: joins with it
    are planned by its true size, and an empty one removes its branch of the plan.
    """
    rows = list(rows)
    columns = zip(*rows) if rows else [[] for _ in schema]
    arrays = [pa.array(list(c), _ARROW[type(f.dataType)]) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema)


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
