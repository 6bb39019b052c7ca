"""Session helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources import scratch
from ..sources.scratch import scope, scratch_path, shared_folder

__all__ = ["bound_batches", "fold", "fresh", "kept", "map_frames", "materialize", "or_none", "scope", "scratch_path", "shared_folder", "table", "text_or_empty"]

#: Rows and bytes that go to a Python worker at once. Texts can be long, and a worker holds a batch several times over.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS and BATCH_BYTES, unless they are smaller.

    It is a setting of the session, so other queries of it have smaller batches too: the bound must
    hold when a lazy result is written, which may be long after this.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """sources.scratch.materialize(), with batches of bounded size."""
    bound_batches(df.sparkSession)
    return scratch.materialize(df, tag)


def kept(df: DataFrame, tag: str) -> DataFrame:
    """sources.scratch.kept(), with batches of bounded size."""
    bound_batches(df.sparkSession)
    return scratch.kept(df, tag)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that start with the given ones and clash with none of df, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        got = f"_{name}"
        while got.lower() in taken:
            got += "_"
        taken.add(got.lower())
        out.append(got)
    return out


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def fold(name: str, parts: int):
    """crc32 of the id, as text, modulo parts; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) % parts


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """mapInPandas() that keeps integers integers: pandas' own would hand a column that holds a null over as
    floats, which merges ids beyond 2**53. Such a column is of pandas' Int64 here, its nulls are pd.NA.
    """

    def frame(batch: pa.RecordBatch) -> pd.DataFrame:
        columns = zip(batch.schema.names, batch.columns)
        return pd.DataFrame({n: c.to_pandas(types_mapper={c.type: pd.Int64Dtype()}.get) if c.null_count and pa.types.is_integer(c.type) else c.to_pandas() for n, c in columns})

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frame(batch) for batch in batches):
            yield pa.RecordBatch.from_pandas(out[kinds.names], kinds, preserve_index=False)

    return df.mapInArrow(over, schema)


def or_none(ids: pd.Series) -> list:
    """The ids as plain values, None for null."""
    return [None if x is None or x is pd.NA or x != x else x for x in ids.tolist()]
