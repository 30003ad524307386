"""Named suites of runs, tables of their results as text, and the counters by which a run is watched."""

from __future__ import annotations

import html
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .evidence import experiment_matrix

# Suites with their data, query set and whether they have to be asked for, as they are large.
SUITES = {
    "smartphone": ("smartphone-paper", None, False),
    "road-smoke": ("bangladesh-road-smoke", None, False),
    "road-full": ("bangladesh-road-paper", None, True),
    "road-full-20q": ("bangladesh-road-paper", "bangladesh-road-queries-20", True),
}
# The treatments that a setup compares.
SETUPS = {"baseline": ("baseline",), "upgrade": ("aes-dscp",), "paired": ("baseline", "aes-dscp"), "ablation": ("baseline", "aes-only", "dscp-only", "aes-dscp")}


def plan(spark: SparkSession, suite: str, setup: str, k: int = 10, partitions: int = 4, repetitions: int = 1, allow_full: bool = False) -> DataFrame:
    """The runs of a suite: run, dataset, query_set, algorithm, k, partitions, repetition. Large suites have to be allowed."""
    if suite not in SUITES or setup not in SETUPS:
        raise ValueError(f"suites are {', '.join(SUITES)}; setups are {', '.join(SETUPS)}")
    dataset, query_set, large = SUITES[suite]
    if large and not allow_full:
        raise ValueError(f"{suite} is large: allow it with allow_full")
    return experiment_matrix(spark, [dataset], SETUPS[setup], [k], [partitions], repetitions).withColumn("query_set", F.lit(query_set).cast("string"))


def reductions(rows: DataFrame, key: str, first: str, others: list[str]) -> DataFrame:
    """key, the measure ``first`` and each of the others with ``<other>_pct``, what it saves of the first (null if that is 0)."""
    saved = lambda c: F.when(F.col(first) != 0, F.round(F.round((F.col(first) - F.col(c)) / F.col(first) * 100, 9), 2))
    return rows.select(key, first, *[x for c in others for x in (F.col(c), saved(c).alias(f"{c}_pct"))])


def rendered(table: DataFrame, kind: str, key: str, first: str, others: list[str]) -> DataFrame:
    """A table of ``reductions`` as the lines (line_no, value) of a file: csv, markdown or latex. Rows are in order of their
    key; there is one for each query or dataset of a comparison. A null is an empty field or a dash; key values are escaped."""
    number = lambda c: F.coalesce(F.format_number(F.col(c), 0), F.lit("-"))
    pct = lambda c, sign: F.concat(number(c), F.when(F.col(f"{c}_pct").isNull(), "").otherwise(F.concat(F.lit(" ("), F.format_string("%.2f", F.col(f"{c}_pct")), F.lit(f"{sign})"))))
    name = F.coalesce(F.col(key).cast("string"), F.lit("-"))
    if kind == "csv":
        columns = [key, first, *[x for c in others for x in (c, f"{c}_pct")]]
        quoted = F.when(name.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)
        body = F.concat_ws(",", quoted, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns[1:]])
        head, tail = [",".join(columns)], []
    elif kind == "markdown":
        body = F.concat(F.lit("| "), F.concat_ws(" | ", F.replace(name, F.lit("|"), F.lit("\\|")), number(first), *[pct(c, "%") for c in others]), F.lit(" |"))
        head, tail = ["| " + " | ".join([key, first, *others]) + " |", "| --- |" + " ---: |" * (1 + len(others))], []
    elif kind == "latex":
        body = F.concat(F.concat_ws(" & ", _latex(name), number(first), *[pct(c, "\\%") for c in others]), F.lit(" \\\\"))
        titles = " & ".join(t.replace("_", "\\_") for t in [key, first, *others])
        head, tail = ["\\begin{tabular}{l" + "r" * (1 + len(others)) + "}", "\\hline", titles + " \\\\", "\\hline"], ["\\hline", "\\end{tabular}"]
    else:
        raise ValueError("kinds are csv, markdown and latex")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first(key)))  # one row for each compared run: few
    lines = table.select((place + len(head)).cast("long").alias("line_no"), body.alias("value"))
    fixed = [(i + 1, v) for i, v in enumerate(head)] + [(2**40 + i, v) for i, v in enumerate(tail)]
    return lines.unionByName(table.sparkSession.createDataFrame(fixed, "line_no long, value string"))


def _latex(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")


def bars(title: str, values: Mapping[str, float], width: int = 640, height: int = 360) -> str:
    """A bar chart of a few values as SVG; percentages say what is saved against the first."""
    top, floor, side = 50, height - 40, 40
    step = (width - 2 * side) / max(len(values), 1)
    scale = (floor - top) / (max(values.values(), default=0) or 1)
    base = next(iter(values.values()), 0)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f'<text x="{side}" y="24">{html.escape(title)}</text>']
    for i, (name, value) in enumerate(values.items()):
        x, tall = side + i * step, value * scale
        saved = f" (-{(base - value) / base:.1%})" if i and base else ""
        out.append(f'<rect x="{x + step * 0.15:.1f}" y="{floor - tall:.1f}" width="{step * 0.7:.1f}" height="{tall:.1f}" fill="#777"/>')
        out.append(f'<text x="{x + step / 2:.1f}" y="{floor - tall - 6:.1f}" text-anchor="middle" font-size="11">{value:,.0f}{saved}</text>')
        out.append(f'<text x="{x + step / 2:.1f}" y="{floor + 18}" text-anchor="middle" font-size="12">{html.escape(name)}</text>')
    return "\n".join([*out, "</svg>", ""])


def watched(expected: DataFrame, arrived: DataFrame, answers: DataFrame) -> DataFrame:
    """Per query_id how many rows were expected, arrived and answer; the share that arrived (null if none was expected),
    whether it was worked off (1 or 0; null without answers where nothing was expected) and what is amiss."""
    count = lambda rows, name: rows.groupBy("query_id").agg(F.count("*").alias(name))
    found = count(expected, "expected").join(count(arrived, "arrived"), "query_id", "full").join(count(answers, "answers"), "query_id", "full").na.fill(0)
    e, a = F.col("expected"), F.col("arrived")
    done = F.when((F.col("answers") > 0) & (a >= e), 1.0).when(e > 0, 0.0)
    amiss = F.when(a < e, F.format_string("%d of %d expected rows arrived", a, e))
    return found.select("query_id", "expected", "arrived", "answers", F.when(e > 0, F.round(a / e, 6)).alias("ingestion"), done.alias("processing"), amiss.alias("issue"))


def checked(measures: DataFrame, at_least: Mapping[str, float]) -> DataFrame:
    """measures (measure, got) held against the least that is asked of them: measure, wanted, got, held. A measure that is
    missing or null doesn't hold."""
    wanted = measures.sparkSession.createDataFrame([(k, float(v)) for k, v in at_least.items()], "measure string, wanted double")
    return wanted.join(measures.select("measure", F.col("got").cast("double")), "measure", "left").withColumn("held", F.coalesce(F.col("got") >= F.col("wanted"), F.lit(False)))
