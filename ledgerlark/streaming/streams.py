"""Structured Streaming forms of the stateful behaviours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The prompt budget.
PER_HOUR, CONSECUTIVE, REISSUE_HOURS = 4, 3, 24


def follow(spark: SparkSession, path: str, schema: str, per_trigger: int = 100) -> DataFrame:
    """An append-only ledger of JSON lines; the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def first_copies(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """The first copy of each key; state is kept as long as copies may be late."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def usage_windows(stream: DataFrame, delay: str = "2 days", width: str = "1 hour") -> DataFrame:
    w = stream.withWatermark("recorded_at", delay).groupBy(F.window("recorded_at", width), "action").agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("not_ok"))
    return w.select(F.col("window.start").alias("hour"), "action", "requests", "not_ok")


def prompt_decision(history: list[float], run: int, locks: dict[str, float], t: float, digest: str, revised: bool) -> tuple[str, list[float], int, dict[str, float]]:
    """One request against the budget: at most PER_HOUR in (t-3600, t], CONSECUTIVE in a row before one is refused, and the same
    digest not again within REISSUE_HOURS unless it was revised."""
    history = [h for h in history if h > t - 3600]
    locks = {k: v for k, v in locks.items() if v > t}
    if digest in locks and not revised:
        return "reissue-locked", history, run, locks
    if len(history) >= PER_HOUR:
        return "hour-budget", history, run, locks
    if run >= CONSECUTIVE:
        return "consecutive", history, 0, locks
    return "granted", [*history, t], run + 1, {**locks, digest: t + REISSUE_HOURS * 3600}


def prompt_budget(stream: DataFrame) -> DataFrame:
    """Decisions (principal_id, at, digest, decision) for requests (principal_id, at, digest, revised), in time order per
    principal within a batch. A request older than the last decision is decided at that time, never dropped."""
    schema = "principal_id string, at timestamp, digest string, decision string"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hist, n, keys, until = (list(x) if isinstance(x, (list, tuple)) else x for x in state.get) if state.exists else ([], 0, [], [])
        locks = dict(zip(keys, until))
        pdf = pd.concat(list(frames)).sort_values(["at", "digest"])
        rows = []
        for r in pdf.itertuples(index=False):
            t = max(r.at.timestamp(), hist[-1] if hist else 0.0)
            d, hist, n, locks = prompt_decision(hist, n, locks, t, r.digest, bool(r.revised))
            rows.append((key[0], r.at, r.digest, d))
        state.update((hist, n, list(locks), list(locks.values())))
        yield pd.DataFrame(rows, columns=["principal_id", "at", "digest", "decision"])

    return stream.groupBy("principal_id").applyInPandasWithState(run, schema, "hist array<double>, run int, digests array<string>, until array<double>", "append", GroupStateTimeout.NoTimeout)


def derive_touched(stream: DataFrame, ledger: Callable[[], DataFrame], key: str, derive: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Per micro-batch, derives again only the cohorts that it touches; each batch writes its own folder, so a repeated batch
    replaces its result."""

    def batch(df: DataFrame, n: int) -> None:
        touched = df.select(key).filter(F.col(key).isNotNull()).distinct()
        derive(ledger().join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def view_holds(boundaries: DataFrame, was: str, now: str) -> bool:
    """Whether a view of ``was`` still holds at ``now``: no effective_from or expiry lies in between, either way round."""
    a, b = sorted([was, now])
    edge = lambda c: (F.col(c) > F.lit(a).cast("timestamp")) & (F.col(c) <= F.lit(b).cast("timestamp"))
    return boundaries.filter(edge("effective_from") | edge("expiry")).limit(1).count() == 0
