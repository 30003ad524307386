"""Connected components of a table of links, by smallest label with pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Rows of a written table for each task at least, so that a small graph isn't many tiny files.
ROWS_A_TASK = 250_000


def _written(table: DataFrame, rows: int, folder: str, name: str) -> DataFrame:
    """``table``, of at most ``rows`` rows, written in no more tasks than they need."""
    return materialize(table.coalesce(max(1, math.ceil(rows / ROWS_A_TASK))), folder, name)


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, label) of all nodes of links (a, b); label is the smallest node of the component.

    Each round every node takes the least label among its neighbours and then its label's
    label. A round is one written table; it ends when no label changes. Aggregation is
    partial before it shuffles, so a hub costs one row for each task. Tables have tasks
    in proportion to the links.
    """
    both = _written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "near").where("node <> near").distinct(), 2 * links.count(), folder, f"{name}-edges")
    rows = both.count()
    labels = _written(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), rows, folder, f"{name}-0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.toDF("near", "other"), "near").groupBy("node").agg(F.min("other").alias("other"))
        taken = labels.join(heard, "node").select("node", "label", F.least("label", "other").alias("low"))
        up = labels.toDF("low", "top")
        jumped = taken.join(up, "low", "left").select("node", F.coalesce(F.least("low", "top"), "low").alias("label"), (F.coalesce(F.least("low", "top"), "low") < F.col("label")).alias("changed"))
        written = _written(jumped, rows, folder, f"{name}-{step}")
        labels = written.select("node", "label")
        if written.where("changed").isEmpty():
            return labels
