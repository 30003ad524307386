"""Live rankings over a sliding window of events, and bounded snapshots of a stream.

State is kept for each query: the instances of the last ``window_ms`` by (object, instance), so an
object of several instances keeps them all; an upsert replaces its instance, a delete removes its object.
The events of a micro-batch are taken in order of time, then object and instance. Each event gives one ranking
(``emit='event'``), or each micro-batch one. A late event (before
latest - window) is kept until the next event removes it, or dropped (``late='drop'``). A timer
clears the state when the watermark passes latest + window; it gives no ranking.
"""

from __future__ import annotations

import heapq
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orthant.operators import impute
from orthant.operators.plane import dominated_sums
from orthant.shipping import ship
from orthant.sources.events import decode

OUT = "query_id string, event_time long, rank int, object_id string, score double, lb double, ub double, n_inst int"
STATE = "latest long, objects array<string>, instances array<string>, times array<long>, p array<double>, attrs array<array<double>>"


def ranking(objects: list[str], p: np.ndarray, attrs: np.ndarray, point: np.ndarray, k: int) -> list[tuple]:
    """(rank, object, score, lb, ub, instances) of the k best objects of one window, in n log n in the plane."""
    if not objects:
        return []
    d = np.abs(attrs - point)
    names, owner = np.unique(np.array(objects, object), return_inverse=True)
    if d.shape[1] == 2:
        every = np.zeros(len(p), np.int64)
        mass = p * (dominated_sums(every, d[:, 0], d[:, 1], p) - dominated_sums(owner, d[:, 0], d[:, 1], p))
    else:
        mass = np.zeros(len(p))
        for i in range(len(p)):  # a row of the comparison at a time: memory is linear in the window
            wins = (d[i] <= d).all(1) & (d[i] < d).any(1) & (owner != owner[i])
            mass[i] = p[i] * p[wins].sum()
    n = len(names)
    score, total, count = np.maximum(np.bincount(owner, mass, n), 0.0), np.bincount(owner, p, n), np.bincount(owner, minlength=n)
    best = np.zeros(n)
    np.maximum.at(best, owner, p)
    lb, ub = np.maximum(score - best, 0.0), np.minimum(p.sum() - total, score + best)
    shown = score.round(6)
    order = np.lexsort((np.arange(n), -shown))[:k]
    return [(i + 1, names[o], float(shown[o]), float(lb[o]), float(ub[o]), int(count[o])) for i, o in enumerate(order)]


class Window:
    """The live instances of one query. Instances leave by a heap of their times, so an event costs what it changes."""

    def __init__(self, window_ms: int, late: str, state: tuple | None):
        self.window_ms, self.late = window_ms, late
        self.latest, self.rows = -1, {}
        if state:
            self.latest = state[0]
            self.rows = {(o, i): (t, p, tuple(a)) for o, i, t, p, a in zip(*state[1:], strict=True)}
        self.times = [(v[0], k) for k, v in self.rows.items()]
        heapq.heapify(self.times)
        self.of_object: dict[str, set] = {}
        for k in self.rows:
            self.of_object.setdefault(k[0], set()).add(k)

    def _remove(self, key: tuple) -> None:
        del self.rows[key]
        self.of_object[key[0]].discard(key)

    def apply(self, object_id: str, instance_id: str, time: int, op: str, p: float, attrs: tuple[float, ...]) -> None:
        self.latest = max(self.latest, time)
        floor = self.latest - self.window_ms
        while self.times and self.times[0][0] < floor:
            t, key = heapq.heappop(self.times)
            if key in self.rows and self.rows[key][0] == t:
                self._remove(key)
        if op == "DELETE":
            for key in list(self.of_object.get(object_id, ())):
                self._remove(key)
        elif time >= floor or self.late == "keep-once":
            key = (object_id, instance_id)
            self.rows[key] = (time, p, attrs)
            self.of_object.setdefault(object_id, set()).add(key)
            heapq.heappush(self.times, (time, key))

    def state(self) -> tuple:
        keys, values = list(self.rows), list(self.rows.values())
        return self.latest, [k[0] for k in keys], [k[1] for k in keys], [v[0] for v in values], [v[1] for v in values], [list(v[2]) for v in values]

    def top(self, point: np.ndarray, k: int) -> list[tuple]:
        return ranking([o for o, _ in self.rows], np.array([v[1] for v in self.rows.values()]), np.array([v[2] for v in self.rows.values()]), point, k)


def imputed(events: DataFrame, dims: int, chosen: DataFrame, buckets: DataFrame) -> DataFrame:
    """A stream of events (attributes array, null where missing) as instances by a synopsis that was trained before;
    deletes keep their identity. The synopsis is a static table, small by its definition."""
    flat = events.select("*", *[F.col("attributes")[d].alias(f"a{d}") for d in range(dims)]).drop("attributes", "missing")
    offered = impute.with_candidates(flat, chosen, buckets, dims)
    done = impute.expand(offered, [F.col(f"cand{d}") for d in range(dims)]).drop(*[f"cand{d}" for d in range(dims)])
    both = impute.with_deletes(done, flat, dims)
    return both.select(*[c for c in both.columns if c not in {f"a{d}" for d in range(dims)}], F.array(*[F.col(f"a{d}") for d in range(dims)]).alias("attributes"))


def live_rankings(events: DataFrame, points: dict[str, list[float]], k: int = 10, window_ms: int = 30_000, delay_ms: int = 1000, emit: str = "event", late: str = "keep-once") -> DataFrame:
    """Rankings of a stream of imputed instances (object_id, instance_id, query_id, event_time TIMESTAMP,
    op_type, p, attributes); events of unknown queries give nothing."""
    ship(events.sparkSession.sparkContext)
    known = events.where(F.col("query_id").isin(*points)).withWatermark("event_time", f"{delay_ms} milliseconds")

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = Window(window_ms, late, tuple(state.get) if state.exists else None)
        point, out = np.array(points[key[0]]), []
        if state.hasTimedOut:
            state.remove()
            return
        rows = [r for batch in batches for r in batch[["millis", "object_id", "instance_id", "op_type", "p", "attributes"]].itertuples(index=False)]
        for r in sorted(rows, key=lambda r: (r.millis, r.object_id, r.instance_id or "")):
            attrs = tuple(map(float, r.attributes)) if r.attributes is not None and r.op_type != "DELETE" else ()
            window.apply(r.object_id, r.instance_id, int(r.millis), r.op_type, float(r.p) if attrs else 0.0, attrs)
            if emit == "event":
                out += [(key[0], int(r.millis), *row) for row in window.top(point, k)]
        if emit != "event":
            out += [(key[0], window.latest, *row) for row in window.top(point, k)]
        state.update(window.state())
        state.setTimeoutTimestamp(max(window.latest + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["query_id", "event_time", "rank", "object_id", "score", "lb", "ub", "n_inst"])

    timed = known.withColumn("millis", F.expr("unix_millis(event_time)"))
    return timed.groupBy("query_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def kafka_options(servers: str, topics: str | list[str], starting: str = "earliest", bounded: bool = False) -> dict[str, str]:
    """Options of a Kafka source; a bounded one ends at what is the latest offset when it is planned."""
    named = topics if isinstance(topics, str) else ",".join(topics)
    options = {"kafka.bootstrap.servers": servers, "subscribe": named, "startingOffsets": starting, "failOnDataLoss": "true"}
    return options | {"endingOffsets": "latest"} if bounded else options


def kafka_events(spark: SparkSession, servers: str, topics: str | list[str], starting: str = "earliest", bounded: bool = False) -> DataFrame:
    """The decoded events of Kafka topics, with topic, partition and offset: a stream, or a bounded table."""
    reader = spark.read if bounded else spark.readStream
    raw = reader.format("kafka").options(**kafka_options(servers, topics, starting, bounded)).load()
    return decode(raw.select("topic", "partition", "offset", F.col("value").cast("string").alias("value")), "value")


def snapshot(stream: DataFrame, folder: str, timeout_s: int = 120, expected: int | None = None) -> DataFrame:
    """All that is available now, landed as a table once (a repeated run adds only what is new), to be ranked
    as a batch; an error if nothing is there, a warning if fewer events than expected are. Nothing is cut."""
    writing = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    if not writing.awaitTermination(timeout_s):
        writing.stop()
        raise TimeoutError(f"the stream took more than {timeout_s} s")
    landed = stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/data")
    if landed.isEmpty():
        raise ValueError("the stream has no events")
    if expected is not None and (found := landed.count()) < expected:
        warnings.warn(f"the stream has {found} events of {expected} expected ones", RuntimeWarning, stacklevel=2)
    return landed
