"""Tables between steps, and passes over Arrow batches that use this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.shipping import ship
from orthant.storage import materialize, shared_dir

__all__ = ["map_arrow", "materialize", "plain_columns", "shared_dir", "text_hash"]


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` for functions that use this package."""
    ship(df.sparkSession.sparkContext)
    return df.mapInArrow(run, schema)


def plain_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns under fixed names, so that further columns of the
    caller (whatever they are called) can't clash with the operator's own."""
    return df.select(*[df[source].alias(name) for name, source in wanted.items()])


def text_hash(text: Column) -> Column:
    """With the id, what tells a document from another: rows of one id may have different texts."""
    return F.xxhash64(text)
