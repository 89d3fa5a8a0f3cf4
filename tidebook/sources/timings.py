"""Timings of real runs, as the profiler's statistics (research.timing_block) take them: what each micro-batch spent on what."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "query string, batch long, module string, us double"
#: Times of a batch's stateful operators, by what they are spent on.
STATE_TIMES = ("allUpdatesTimeMs", "allRemovalsTimeMs", "commitTimeMs")


def rows_of(progress: Iterable) -> list[tuple]:
    """(query, batch, module, us) of query progress reports: each phase of a batch, `total`, and each stateful operator's work."""
    out = []
    for p in progress:
        name = str(p["name"] or p["id"])
        out += [(name, int(p["batchId"]), "total" if k == "triggerExecution" else k, ms * 1000.0) for k, ms in p["durationMs"].items()]
        for i, s in enumerate(p["stateOperators"]):
            out += [(name, int(p["batchId"]), f"state{i}.{k[:-6]}", float(s[k]) * 1000.0) for k in STATE_TIMES if k in s]
    return out


def timings(spark: SparkSession, query) -> DataFrame:
    """The table of a streaming query's last batches (as many as Spark keeps, a hundred by default)."""
    return spark.createDataFrame(rows_of(p for p in query.recentProgress if p["numInputRows"] > 0), SCHEMA)


def phases(table: DataFrame) -> DataFrame:
    """Rows of phases alone, which add up to a batch, for shares."""
    return table.where("module <> 'total' and not startswith(module, 'state')")
