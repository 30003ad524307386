"""Event records: JSON codec, CSV scans with discovered columns, sidecar query sets, sinks."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.operators.instances import SHARED_QUERY

JSON_SCHEMA = "objectId string, instanceId string, queryId string, eventTime long, appearanceProbability double, serverPartition int, opType string, attributes array<double>, missingMask array<boolean>, mbrMin array<double>, mbrMax array<double>"
# What stands for a missing attribute.
MISSING = ("", "?", "null", "nan")


def encode(columns: list[str]) -> Column:
    """A JSON record; missing values are written as null."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def decode(rows: DataFrame, value: str = "value") -> DataFrame:
    """JSON records as typed columns beside the others of ``rows``. A null or NaN attribute is missing whatever
    the mask says; masked attributes are null."""
    parsed = rows.withColumn("_e", F.from_json(F.col(value).cast("string"), JSON_SCHEMA)).drop(value)
    gone = lambda x, m: F.coalesce(m, F.lit(False)) | x.isNull() | F.isnan(x)
    e = lambda name: F.col(f"_e.{name}")
    missing = F.zip_with(e("attributes"), e("missingMask"), gone)
    kept = F.zip_with(e("attributes"), e("missingMask"), lambda x, m: F.when(~gone(x, m), x))
    empty = F.expr("cast(array() as array<double>)")
    return parsed.select("*", e("objectId").alias("object_id"), F.coalesce(e("instanceId"), F.concat(e("objectId"), F.lit("#raw"))).alias("instance_id"), e("queryId").alias("query_id"), F.timestamp_millis(e("eventTime")).alias("event_time"), F.coalesce(e("appearanceProbability"), F.lit(1.0)).alias("p"), F.coalesce(e("serverPartition"), F.lit(-1)).alias("server_partition"), F.coalesce(e("opType"), F.lit("UPSERT")).alias("op_type"), kept.alias("attributes"), missing.alias("missing"), F.coalesce(e("mbrMin"), empty).alias("mbr_min"), F.coalesce(e("mbrMax"), empty).alias("mbr_max")).drop("_e")


def number(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(~text.isin(*MISSING), text.try_cast("double"))


def _suffixed(names: list[str], prefix: str) -> list[str]:
    """Columns prefix + X, Y or a number, in that order."""
    rank = {"x": -2, "y": -1}
    found = [(rank.get(n.lower()[len(prefix) :], None) if n.lower()[len(prefix) :] in rank else int(n[len(prefix) :]), n) for n in names if n.lower().startswith(prefix.lower()) and (n.lower()[len(prefix) :] in rank or n[len(prefix) :].isdigit())]
    return [n for _, n in sorted(found)]


def read_csv(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """Event rows of CSV files with a header (names in any case, # lines skipped): the known columns, attributes
    a0.. (columns a<number>, else all after opType or eventTime), query point q0.. and box mbr_lo0.., mbr_hi0.. . With ``place`` a column row_place orders rows as they lie in the files."""
    raw = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    by_name = {n.lower(): n for n in raw.columns}
    get = lambda name, default: F.col(f"`{by_name[name]}`") if name in by_name else F.lit(default)
    attributes = sorted((n for n in raw.columns if re.fullmatch(r"[aA]\d+", n)), key=lambda n: int(n[1:]))
    if not attributes:
        after = raw.columns.index(by_name.get("optype") or by_name["eventtime"])
        attributes = raw.columns[after + 1 :]
    object_id = get("objectid", None)
    out = [object_id.alias("object_id"), F.coalesce(get("instanceid", None), F.concat(object_id, F.lit("#raw"))).alias("instance_id"), get("queryid", "q0").alias("query_id"), F.timestamp_millis(get("eventtime", "0").cast("long")).alias("event_time"), F.upper(F.coalesce(get("optype", None), F.lit("UPSERT"))).alias("op_type"), F.coalesce(number(get("probability", None).cast("string")), F.lit(1.0)).alias("p"), F.coalesce(get("serverid", None).cast("int"), F.lit(-1)).alias("server_partition")]
    out += [number(F.col(f"`{n}`")).alias(f"a{d}") for d, n in enumerate(attributes)]
    for prefix, name in (("queryA", "q"), ("mbrMin", "mbr_lo"), ("mbrMax", "mbr_hi")):
        out += [number(F.col(f"`{n}`")).alias(f"{name}{d}") for d, n in enumerate(_suffixed(raw.columns, prefix))]
    if place:  # rows of one piece of a file are read in order by one task
        out.append(F.struct("_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("row_place"))
    return raw.select(*out)


def queries_of(rows: DataFrame, dims: int, order: str = "instance_id") -> DataFrame:
    """The query point of each query: that of its first row by ``order`` (``row_place`` of read_csv is the files' order)."""
    first = rows.groupBy("query_id").agg(F.min_by(F.struct(*[f"q{d}" for d in range(dims)]), order).alias("_q"))
    return first.select("query_id", "_q.*")


def read_query_set(spark: SparkSession, path: str) -> DataFrame:
    """A sidecar query set (queryId, queryA0, ..); its ids must be unique."""
    raw = spark.read.option("header", True).option("comment", "#").csv(path)
    by_name = {n.lower(): n for n in raw.columns}
    out = raw.select(F.col(by_name["queryid"]).alias("query_id"), *[F.col(n).cast("double").alias(f"q{d}") for d, n in enumerate(_suffixed(raw.columns, "queryA"))])
    if out.groupBy("query_id").count().where("count > 1").limit(1).count():
        raise ValueError(f"query ids repeat in {path}")
    return out


def shared_input(rows: DataFrame) -> DataFrame:
    """Rows that belong to every query of a sidecar set."""
    return rows.withColumn("query_id", F.lit(SHARED_QUERY))


def write_results(top: DataFrame, path: str) -> None:
    """query_id, rank, object_id, score, lower_bound, upper_bound, instances as CSV with six decimals."""
    six = lambda c: F.format_string("%.6f", F.col(c).cast("double"))
    top.select("query_id", "rank", "object_id", six("score").alias("score"), six("lb").alias("lower_bound"), six("ub").alias("upper_bound"), F.col("n_inst").alias("instances")).orderBy("query_id", "rank").write.mode("overwrite").option("header", True).csv(path)


def text_report(top: DataFrame) -> DataFrame:
    """One readable line for each ranked object."""
    return top.orderBy("query_id", "rank").select(F.format_string("query=%s rank=%d object=%s score=%.6f", "query_id", "rank", F.col("object_id").cast("string"), "score").alias("value"))


def archive_run(folder: str, manifest: dict, **tables: DataFrame) -> None:
    """Tables of a run as Parquet and its manifest as JSON, in one folder."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
