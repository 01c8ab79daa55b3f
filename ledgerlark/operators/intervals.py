"""Merging overlapping intervals into continuous periods and listing the gaps, by dyadic blocks.

An interval of integers is the disjoint union of few dyadic blocks [k*2^l, (k+1)*2^l). Two blocks nest or are disjoint, so
blocks covered by an ancestor are found in one sorted sweep, siblings that are both present become their parent, and
adjacent blocks of what remains are the continuous runs.

Time is cut into slabs, dyadic blocks of 2^SLAB_BITS ms. An interval leaves its ends in at most two slabs, and what lies
between as a run of whole slabs. Each (key, slab) is independent, so a key with a third of all rows is spread over its slabs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLAB_BITS = 31
#: An open end. All bounds of real timestamps lie far below.
OPEN = 1 << 52
#: Whole-slab runs have this slab; their positions count slabs from -BIAS.
COARSE, BIAS = -(1 << 40), 1 << 18
_SPAN = 1 << 32
#: Rows merged at a time. Each has some 15 to 30 blocks.
_HOLD = 100_000


def canonical_blocks(gid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The canonical dyadic blocks (gid, start, level) of the intervals [lo, hi), lo >= 0."""
    g, s, lv = [], [], []
    level = 0
    keep = lo < hi
    gid, lo, hi = gid[keep], lo[keep].astype(np.int64), hi[keep].astype(np.int64)
    while len(lo):
        left, right = (lo & 1) == 1, (hi & 1) == 1
        for at, pos in ((left, lo), (right, hi - 1)):
            g.append(gid[at])
            s.append(pos[at] << level)
            lv.append(np.full(int(at.sum()), level, np.int64))
        lo, hi = (lo + left) >> 1, hi >> 1
        keep = lo < hi
        gid, lo, hi = gid[keep], lo[keep], hi[keep]
        level += 1
    if not g:
        e = np.empty(0, np.int64)
        return e, e, e
    return np.concatenate(g), np.concatenate(s), np.concatenate(lv)


def dyadic_runs(gid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint maximal runs (gid, lo, hi), sorted, of what the intervals cover. 0 <= lo, hi < 2^32."""
    gid, start, level = canonical_blocks(np.asarray(gid, np.int64), np.asarray(lo), np.asarray(hi))
    if not len(gid):
        return gid, start, start
    order = np.lexsort((-level, start, gid))
    gid, start, level = gid[order], start[order], level[order]
    a = gid * _SPAN + start
    b = a + (1 << level)
    covered = np.zeros(len(a), bool)
    covered[1:] = b[1:] <= np.maximum.accumulate(b)[:-1]
    a, level = a[~covered], level[~covered]
    for at in range(int(level.max()) + 1):  # siblings upward; a parent can find its own sibling one level higher
        size = 1 << at
        first = np.flatnonzero((level[:-1] == at) & (level[1:] == at) & ((a[:-1] >> at) & 1 == 0) & (a[1:] - a[:-1] == size))
        if len(first):
            level = level.copy()
            level[first] = at + 1
            stay = np.ones(len(a), bool)
            stay[first + 1] = False
            a, level = a[stay], level[stay]
    b = a + (1 << level)
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != b[:-1]
    last = np.append(new[1:], True)
    return a[new] // _SPAN, a[new] % _SPAN, b[last] - (a[new] // _SPAN) * _SPAN


_PIECES = "key string, slab bigint, lo bigint, hi bigint"
_ARROW = pa.schema([("key", pa.string()), ("slab", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Runs of each (key, slab), keys in the order of their first rows."""
    t = pa.concat_tables(tables)
    d = t.column("key").combine_chunks()
    d = (pa.concat_arrays(d.chunks) if isinstance(d, pa.ChunkedArray) else d).dictionary_encode()
    slabs, s = np.unique(t.column("slab").to_numpy(), return_inverse=True)
    g = d.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(slabs) + s
    names, g = np.unique(g, return_inverse=True)
    gid, lo, hi = dyadic_runs(g, t.column("lo").to_numpy(), t.column("hi").to_numpy())
    code = names[gid]
    return pa.table([d.dictionary.take(pa.array(code // len(slabs))), slabs[code % len(slabs)], lo, hi], schema=_ARROW)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task as tables of one schema; Spark marks columns that can't be null."""
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch]).cast(_ARROW)


def _batches(t: pa.Table) -> list[pa.RecordBatch]:
    return t.combine_chunks().to_batches(max_chunksize=20_000)


def _merge_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each (key, slab) among rows that lie near each other, in any order. What merging hasn't halved goes out, so about
    _HOLD rows are held at the most."""
    held: list[pa.Table] = []
    rows = 0
    for t in _parts(batches):
        held.append(t)
        rows += t.num_rows
        if rows >= _HOLD:
            t = _merged(held)
            if 2 * t.num_rows > rows:
                yield from _batches(t)
                t = t.slice(0, 0)
            held, rows = [t], t.num_rows
    if rows:
        yield from _batches(_merged(held))


def _merge_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each (key, slab) of rows sorted by key, slab and lo. Only the last run can reach into the rows to come, so it alone
    is kept; about _HOLD rows are held at the most, whatever a group has."""
    held: list[pa.Table] = []
    rows = 0
    for t in _parts(batches):
        held.append(t)
        rows += t.num_rows
        if rows >= _HOLD:
            t = _merged(held)
            yield from _batches(t.slice(0, t.num_rows - 1))
            held, rows = [t.slice(t.num_rows - 1)], 1
    if rows:
        yield from _batches(_merged(held))


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Rows (key, row_kind, from_ms, until_ms): each key's maximal covered stretches (``period``) and the stretches between
    two consecutive ones (``gap``), in epoch milliseconds; until_ms is -1 for an open period.

    Intervals are half-open; touching ones belong together. A null end is open. Rows with null key or start, and intervals
    that end at or before their start, are ignored. Repeated rows change nothing; an empty table gives no rows; other
    columns are not read. Merged where rows lie before the shuffle, so repeated cover isn't moved. A task holds a bounded number
    of rows in Python, however many it has.
    """
    size = 1 << SLAB_BITS
    iv = df.select(F.col(key).alias("key"), F.unix_millis(F.col(start).cast("timestamp")).alias("s"), F.coalesce(F.unix_millis(F.col(end).cast("timestamp")), F.lit(OPEN)).alias("e"))
    iv = iv.filter("key is not null and s is not null and e > s")
    iv = iv.withColumn("a", F.shiftright("s", SLAB_BITS)).withColumn("b", F.shiftright("e", SLAB_BITS))
    rs, re_ = F.col("s") - F.col("a") * size, F.col("e") - F.col("b") * size
    piece = lambda slab, lo, hi: F.struct(slab.cast("bigint").alias("slab"), lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    one = F.array(piece(F.col("a"), rs, re_))
    many = F.array(
        piece(F.col("a"), rs, F.lit(size)),
        piece(F.lit(COARSE), F.col("a") + 1 + BIAS, F.col("b") + BIAS),
        piece(F.col("b"), F.lit(0), re_),
    )
    pieces = iv.select("key", F.explode(F.when(F.col("a") == F.col("b"), one).otherwise(many)).alias("p")).select("key", "p.*").filter("lo < hi")
    near = pieces.mapInArrow(_merge_near, _PIECES).repartition("key", "slab")
    runs = near.sortWithinPartitions("key", "slab", "lo").mapInArrow(_merge_sorted, _PIECES)
    at = lambda c: F.when(F.col("slab") == COARSE, (F.col(c) - BIAS) * size).otherwise(F.col("slab") * size + F.col(c))
    runs = runs.select("key", at("lo").alias("s"), at("hi").alias("e")).withColumn("slab", F.shiftright("s", SLAB_BITS))
    # One row per (key, slab) is all that a key needs across slabs.
    slabs = runs.groupBy("key", "slab").agg(F.max("e").alias("top"))
    across = W.partitionBy("key").orderBy("slab")
    slabs = slabs.select("key", "slab", F.max("top").over(across.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.max("top").over(W.partitionBy("key")).alias("last"))
    inside = W.partitionBy("key", "slab").orderBy("s", "e")
    starts = (
        runs.join(slabs, ["key", "slab"])
        .withColumn("prior", F.greatest("before", F.max("e").over(inside.rowsBetween(W.unboundedPreceding, -1))))
        .filter("prior is null or s > prior")
        .withColumn("next_prior", F.lead("prior").over(inside))
    )
    heads = starts.groupBy("key", "slab").agg(F.min(F.struct("s", "prior")).alias("h")).select("key", "slab", F.lead("h.prior").over(across).alias("slab_next"))
    starts = starts.join(heads, ["key", "slab"])
    until = F.coalesce("next_prior", "slab_next", "last")
    period = F.struct(F.lit("period").alias("row_kind"), F.col("s").alias("from_ms"), F.when(until >= OPEN, F.lit(-1)).otherwise(until).alias("until_ms"))
    gap = F.struct(F.lit("gap").alias("row_kind"), F.col("prior").alias("from_ms"), F.col("s").alias("until_ms"))
    rows = F.when(F.col("prior").isNull(), F.array(period)).otherwise(F.array(period, gap))
    return starts.select(F.col("key").alias(key), F.explode(rows).alias("r")).select(key, "r.*")
