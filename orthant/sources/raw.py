"""Raw archives as event tables: Intel lab text, pump and gas ZIP files, road shapefiles; and the registry.

ZIP files can't be split, so each is read by one task, which streams its lines out; everything
after that is columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import number, read_csv
from .generators import region_objects, smartphone_objects, synthetic_events

GAS_BASE_MS = 1_700_000_000_000


def zip_lines(spark: SparkSession, path: str, suffix: str, heads: bool = False) -> DataFrame:
    """file, line_no, line of the members (also of ZIP files within) whose names end so; of ``heads`` only the first lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        def members(data, prefix):
            with zipfile.ZipFile(data) as z:
                for name in sorted(z.namelist()):
                    if name.lower().endswith(".zip"):
                        yield from members(io.BytesIO(z.read(name)), f"{prefix}{name}/")
                    elif name.lower().endswith(suffix):
                        with z.open(name) as f:
                            yield prefix + name, io.TextIOWrapper(f, "utf-8", errors="replace")

        for batch in batches:
            for content in batch.column(0):
                for name, lines in members(io.BytesIO(content.as_py()), ""):
                    part, n = [], 0
                    for line in lines:
                        part.append((name, n, line.rstrip("\r\n")))
                        n += 1
                        if heads:
                            break
                        if len(part) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["file", "line_no", "line"])
                            part = []
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part, strict=True)], names=["file", "line_no", "line"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "file string, line_no long, line string")


def _event(object_id: Column, query_id: Column, time: Column, attributes: list[Column]) -> list[Column]:
    return [object_id.alias("object_id"), F.concat(object_id, F.lit("#raw")).alias("instance_id"), query_id.alias("query_id"), time.alias("event_time"), F.lit("UPSERT").alias("op_type"), F.lit(1.0).alias("p"), F.lit(-1).alias("server_partition"), *[a.alias(f"a{d}") for d, a in enumerate(attributes)]]


def read_intel(spark: SparkSession, path: str, max_events: int | None = None) -> DataFrame:
    """Lines date time epoch mote and four readings, parted by white space (gzip or not)."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(parts) >= 5)
    at = lambda i: F.when(F.size(parts) > i, parts[i])
    time = F.try_to_timestamp(F.concat_ws(" ", parts[0], F.substring(parts[1], 1, 8)), F.lit("yyyy-MM-dd HH:mm:ss"))
    out = rows.select(*_event(F.concat(F.lit("intel-mote-"), parts[3]), F.lit("q0"), time, [number(at(i)) for i in range(4, 8)])).where("event_time is not null")
    return out.orderBy("event_time", "object_id").limit(max_events) if max_events else out


def _first(rows: DataFrame, max_events: int | None) -> DataFrame:
    """The first rows by file and line."""
    return rows.orderBy("file", "line_no").limit(max_events) if max_events else rows


def read_pump(spark: SparkSession, path: str, max_events: int | None = None) -> DataFrame:
    """CSV in a ZIP: a timestamp, all columns sensor_*, and a status that names the query. The members of an archive
    must have one header; no member is an error."""
    headers = [r["line"] for r in zip_lines(spark, path, ".csv", heads=True).select("line").distinct().limit(2).collect()]
    if len(headers) != 1:
        raise ValueError(f"{path} has {'no' if not headers else 'more than one'} header")
    header = headers[0].split(",")
    lines = _first(zip_lines(spark, path, ".csv").where("line_no > 0 and line <> ''"), max_events)
    parts = F.split("line", ",", -1)
    sensors = [i for i, n in enumerate(header) if n.strip().lower().startswith("sensor_")]
    time = F.try_to_timestamp(parts[header.index("timestamp")], F.lit("yyyy-MM-dd HH:mm:ss"))
    status = F.lower(F.trim(parts[len(header) - 1]))
    return lines.select(*_event(F.concat(F.lit("pump-"), F.col("line_no").cast("string")), F.concat(F.lit("pump-"), status), time, [number(parts[i]) for i in sensors]))


def read_gas(spark: SparkSession, path: str, max_events: int | None = None) -> DataFrame:
    """White-space tables (.dat) in a ZIP in a ZIP: id, hours, ten readings."""
    parts = F.split(F.trim("line"), r"\s+")
    rows = _first(zip_lines(spark, path, ".dat").where((F.size(parts) >= 12) & parts[0].rlike(r"^\d+$")), max_events)
    time = F.timestamp_millis((F.lit(GAS_BASE_MS) + F.round(parts[1].try_cast("double") * 3_600_000)).cast("long"))
    return rows.select(*_event(F.concat(F.lit("gas-"), parts[0], F.lit("-"), F.col("line_no").cast("string")), F.lit("q0"), time, [number(parts[i]) for i in range(2, 12)]))


def as_arrays(events: DataFrame) -> DataFrame:
    """Attributes as one array, so that tables of different widths can be united."""
    names = sorted((c for c in events.columns if c[0] == "a" and c[1:].isdigit()), key=lambda c: int(c[1:]))
    return events.select(*[c for c in events.columns if c not in names], F.array(*names).alias("attributes"))


def all_raw(*tables: DataFrame) -> DataFrame:
    out = as_arrays(tables[0])
    for t in tables[1:]:
        out = out.unionByName(as_arrays(t))
    return out


def read_all(spark: SparkSession, intel: str, pump: str, gas: str, max_events: int | None = None) -> DataFrame:
    """The three raw archives as one table; ``max_events`` holds for each."""
    return all_raw(read_intel(spark, intel, max_events), read_pump(spark, pump, max_events), read_gas(spark, gas, max_events))


def read_shapes(spark: SparkSession, path: str, widen: float = 1.0) -> DataFrame:
    """Boxes of the polylines (3) and polygons (5) of .shp files, in their own units; an axis of no extent is
    widened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import struct

        for batch in batches:
            for content in batch.column(0):
                data, at, out = content.as_py(), 100, []
                while at + 12 <= len(data):
                    number, words = struct.unpack(">ii", data[at : at + 8])
                    (kind,) = struct.unpack("<i", data[at + 8 : at + 12])
                    if kind in (3, 5):
                        out.append((number, *struct.unpack("<4d", data[at + 12 : at + 44])))
                    at += 8 + 2 * words
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], schema=pa.schema([("object_id", pa.int32()), *[(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")]]))

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "object_id int, x0 double, y0 double, x1 double, y1 double")
    half = lambda lo, hi: F.when(F.col(lo) == F.col(hi), widen / 2).otherwise(0.0)
    return raw.select(F.col("object_id").cast("long").alias("object_id"), (F.col("x0") - half("x0", "x1")).alias("mbr_lo0"), (F.col("y0") - half("y0", "y1")).alias("mbr_lo1"), (F.col("x1") + half("x0", "x1")).alias("mbr_hi0"), (F.col("y1") + half("y0", "y1")).alias("mbr_hi1"))


def topics(name: str, override: str | None = None, prefix: str = "events") -> dict[str, str]:
    """MQTT and Kafka topics of a data set."""
    return {"mqtt": f"{prefix}/raw/{name}", "kafka": override or f"{prefix}.raw.{name}"}


PROVIDERS: dict[str, Callable[..., DataFrame]] = {"synthetic": synthetic_events, "csv": read_csv, "intel": read_intel, "pump": read_pump, "gas": read_gas, "all": read_all, "regions": region_objects, "smartphone": smartphone_objects, "shapes": read_shapes}


def provider(name: str | None) -> Callable[..., DataFrame]:
    """A loader by name; blank and "dummy" mean the synthetic one."""
    key = (name or "synthetic").strip().lower() or "synthetic"
    key = {"dummy": "synthetic"}.get(key, key)
    if key not in PROVIDERS:
        raise ValueError(f"unknown data set {name!r}; there are {', '.join(PROVIDERS)}")
    return PROVIDERS[key]
