"""Percentiles of very large numeric columns, with bounded rank error.

A summary of n values is a list of tuples (value, rmin, rmax), ascending: the value's rank in the whole multiset lies in
[rmin, rmax]. Summaries are deterministic. Merging adds up rank intervals, compressing drops tuples as far as the
permitted uncertainty allows, and ``rank_error`` states what uncertainty has accumulated. Summaries of partitions, days
or months are merged the same way, so every result of a longer span follows from the stored results of its parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.session import partition_bound

EPS = 0.004
#: Summaries that one merge takes; a tree of merges is as deep as the number of summaries needs.
FAN_IN = 32
BLOCK_ROWS = 400_000


class Summary:
    """Rank-interval tuples of n values. ``merge`` and ``compress`` return new summaries."""

    __slots__ = ("value", "rmin", "rmax", "n", "level")

    def __init__(self, value: np.ndarray, rmin: np.ndarray, rmax: np.ndarray, n: int, level: int = 0):
        self.value, self.rmin, self.rmax, self.n, self.level = value, rmin, rmax, int(n), int(level)

    @classmethod
    def of_sorted(cls, values: np.ndarray) -> "Summary":
        ranks = np.arange(1, len(values) + 1, dtype=np.int64)
        return cls(np.asarray(values, np.float64), ranks, ranks, len(values))

    def compress(self, eps: float) -> "Summary":
        """Keeps about 1/eps tuples: one at or below each multiple of eps*n, and both ends."""
        step = eps * self.n
        if step < 2 or len(self.value) <= 2:
            return self
        wanted = np.arange(1.0, self.n + step, step)
        at = np.searchsorted(self.rmin, wanted, side="right") - 1
        at = np.unique(np.concatenate([[0], at.clip(0), [len(self.value) - 1]]))
        return Summary(self.value[at], self.rmin[at], self.rmax[at], self.n, self.level) if len(at) < len(self.value) else self

    def settle(self, eps: float) -> "Summary":
        """Compresses by the level's part of ``eps``, 1/((l+1)(l+2)), and goes up a level. The parts of all levels add up to
        less than 1, so ``eps`` holds for a tree of any depth."""
        out = self.compress(eps / ((self.level + 1) * (self.level + 2)))
        return Summary(out.value, out.rmin, out.rmax, out.n, self.level + 1)

    @staticmethod
    def merge(parts: list["Summary"]) -> "Summary":
        """A tuple's interval in the union is its own plus, of each other summary, the ranks that the nearest tuples there allow.

        All tuples are sorted once, ties by summary; running sums of what each tuple adds to its own summary's lower and
        upper rank give the sums over all summaries at every place.
        """
        parts = [p for p in parts if p.n]
        if len(parts) == 1:
            return parts[0]
        if not parts:
            return Summary(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64), 0)
        value, rmin, rmax = (np.concatenate([getattr(p, k) for p in parts]) for k in ("value", "rmin", "rmax"))
        n = sum(p.n for p in parts)
        rises = np.concatenate([np.diff(p.rmin, prepend=0) for p in parts])
        # Behind a tuple, its summary allows ranks up to the next tuple's, less one, or all of its own.
        behind = np.concatenate([np.append(p.rmax[1:] - 1, p.n) for p in parts])
        falls = behind - (rmax - 1)
        order = np.argsort(value, kind="stable")
        lo = np.cumsum(rises[order])
        f = falls[order]
        hi = rmax[order] + n - (np.cumsum(f[::-1])[::-1] - f) - behind[order]
        return Summary(value[order], np.maximum.accumulate(lo), np.minimum.accumulate(hi[::-1])[::-1], n, max(p.level for p in parts))

    def rank_error(self) -> int:
        """The most ranks by which an answer can miss, at any percentile."""
        if len(self.value) < 2:
            return int((self.rmax - self.rmin).max(initial=0))
        return int(max((self.rmax[1:] - self.rmin[:-1] + 1).max() // 2, (self.rmax - self.rmin).max()))

    def at(self, pct: float) -> tuple[float, int]:
        """The value at rank ceil(pct*n/100), and the most ranks by which it can miss."""
        r = max(1, int(-(-pct * self.n // 100)))
        miss = np.maximum(r - self.rmin, self.rmax - r)
        i = int(miss.argmin())
        return float(self.value[i]), int(miss[i])

    def pack(self) -> bytes:
        return np.array([self.n, self.level], "<i8").tobytes() + self.value.astype("<f8").tobytes() + self.rmin.astype("<i8").tobytes() + self.rmax.astype("<i8").tobytes()

    @classmethod
    def unpack(cls, b: bytes) -> "Summary":
        k = (len(b) - 16) // 24
        n, level = np.frombuffer(b, "<i8", 2).tolist()
        return cls(np.frombuffer(b, "<f8", k, 16), np.frombuffer(b, "<i8", k, 16 + 8 * k), np.frombuffer(b, "<i8", k, 16 + 16 * k), n, level)


def _merge_up(levels: list[list[Summary]], new: Summary, eps: float) -> None:
    """A counter with base FAN_IN: a full level is merged into one summary of the next."""
    levels[0].append(new)
    i = 0
    while len(levels[i]) >= FAN_IN:
        if i + 1 == len(levels):
            levels.append([])
        levels[i + 1].append(Summary.merge(levels[i]).settle(eps))
        levels[i] = []
        i += 1


def _partition_summaries(keys: list[str], value: str, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state: dict[tuple, list[list[Summary]]] = {}
        held: list[pa.RecordBatch] = []
        rows = 0

        def block() -> None:
            t = pa.Table.from_batches(held)
            code = np.zeros(t.num_rows, np.int64)
            names: list[list] = []
            for i in range(len(keys)):
                d = t.column(f"k{i}").combine_chunks()
                d = (d.chunk(0) if isinstance(d, pa.ChunkedArray) else d).dictionary_encode(null_encoding="encode")
                names.append(d.dictionary.to_pylist())
                code = code * len(names[-1]) + d.indices.to_numpy(zero_copy_only=False)
            v = t.column("v").to_numpy().astype(np.float64)
            order = np.lexsort((v, code))
            code, v = code[order], v[order]
            at = np.flatnonzero(np.diff(code, prepend=code[0] - 1))
            for a, b in zip(at, [*at[1:], len(code)]):
                c, key = int(code[a]), []
                for n in reversed(names):
                    c, r = divmod(c, len(n))
                    key.append(n[r])
                _merge_up(state.setdefault(tuple(reversed(key)), [[]]), Summary.of_sorted(v[a:b]).settle(eps), eps)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                block()
                held, rows = [], 0
        if rows:
            block()
        if state:
            yield _rows([(k, Summary.merge([s for level in lv for s in level]).settle(eps)) for k, lv in state.items()], len(keys), part)

    return run


def _rows(items: list[tuple[tuple, Summary]], n_keys: int, part: int) -> pa.RecordBatch:
    cols = [pa.array([k[i] for k, _ in items], pa.string()) for i in range(n_keys)]
    names = [*(f"k{i}" for i in range(n_keys)), "part", "summary"]
    return pa.RecordBatch.from_arrays([*cols, pa.array([part] * len(items), pa.int32()), pa.array([s.pack() for _, s in items], pa.binary())], names=names)


def _local_merge(n_keys: int, eps: float):
    """What summaries of a group lie in one task, merged there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state: dict[tuple, list[list[Summary]]] = {}
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for *k, packed in zip(*cols):
                _merge_up(state.setdefault(tuple(k), [[]]), Summary.unpack(packed), eps)
        if state:
            yield _rows([(k, Summary.merge([s for level in lv for s in level]).settle(eps)) for k, lv in state.items()], n_keys, TaskContext.get().partitionId())

    return run


def _merge_tree(parts: DataFrame, ks: list[str], eps: float, tasks: int) -> DataFrame:
    """One summary per group of ``ks`` from summaries of at most about ``tasks`` numbered parts: rounds of FAN_IN parts."""
    names = [*ks, "part", "summary"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Summary.merge([Summary.unpack(b) for b in pdf["summary"]]).settle(eps)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in ks), 0, s.pack()]], columns=names)

    schema = "".join(f"{k} string, " for k in ks) + "part int, summary binary"
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int"))
        numbered = lambda pdf: run(pdf).assign(part=int(pdf["part"].iloc[0]))
        parts = parts.groupBy(*ks, "part").applyInPandas(numbered, schema)
    return parts.groupBy(*ks).applyInPandas(run, schema).drop("part")


def summarize(df: DataFrame, keys: list[str], value: str, eps: float = EPS) -> DataFrame:
    """One summary per group of ``keys``: columns keys (as strings) and ``summary`` binary.

    Rank error of any percentile is at most eps*n. Null and NaN values are left out; a group of nulls only has no row; null
    keys form a group of their own; ties share their interval; an empty table gives no rows. A group of any share of the
    rows is summarised where its rows lie, and merged FAN_IN summaries at a time, so no task holds a group: a few thousand
    tuples per group leave a task. Columns of other names are not touched, so clashing names cannot matter.
    """
    ks = [f"k{i}" for i in range(len(keys))]
    slim = df.select(*(F.col(k).cast("string").alias(a) for k, a in zip(keys, ks)), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    parts = slim.mapInArrow(_partition_summaries(keys, value, eps), "".join(f"{k} string, " for k in ks) + "part int, summary binary")
    whole = _merge_tree(parts, ks, eps, partition_bound(slim))
    return whole.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), "summary")


def merge_summaries(summaries: DataFrame, keys: list[str], eps: float = EPS) -> DataFrame:
    """Combines stored summaries of finer groups into one per ``keys``. The levels a summary has gone through are stored in it,
    so the error of the whole stays below ``eps``, if it's the one that the parts were made with."""
    ks = [f"k{i}" for i in range(len(keys))]
    slim = summaries.select(*(F.col(k).cast("string").alias(a) for k, a in zip(keys, ks)), "summary")
    parts = slim.mapInArrow(_local_merge(len(ks), eps), "".join(f"{k} string, " for k in ks) + "part int, summary binary")
    whole = _merge_tree(parts, ks, eps, partition_bound(slim))
    return whole.select(*(F.col(a).alias(k) for k, a in zip(keys, ks)), "summary")


def percentiles(summaries: DataFrame, pcts: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Rows (keys, pct int, n bigint, value double, rank_error bigint) for each summary and pct."""
    keys = [c for c in summaries.columns if c != "summary"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                s = Summary.unpack(r[-1])
                for p in pcts:
                    v, miss = s.at(p)
                    rows.append([*r[:-1], p, s.n, v, miss])
            yield pd.DataFrame(rows, columns=[*keys, "pct", "n", "value", "rank_error"])

    schema = ", ".join(f"{k} string" for k in keys) + ", pct int, n bigint, value double, rank_error bigint"
    return summaries.select(*keys, "summary").mapInPandas(run, schema)


def usage_days(usage: DataFrame) -> DataFrame:
    """Usage events, one row per id, with ``recorded_day``. Rows sent again are equal in data; where they differ, the least
    (recorded_at, action, duration_ms) counts. Rows without id or duration are left out."""
    one = usage.filter("id is not null and duration_ms is not null").groupBy("id").agg(F.min(F.struct("recorded_at", "action", "duration_ms")).alias("e"))
    return one.select(F.col("e.action").alias("action"), F.date_format("e.recorded_at", "yyyy-MM-dd").alias("recorded_day"), F.col("e.duration_ms").alias("duration_ms"))
