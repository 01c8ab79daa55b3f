import datetime as dt
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.operators import intervals as I


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 70), st.integers(0, 70)), max_size=25))
def test_runs_equal_the_points_covered(rows):
    g, lo, hi = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    got = [tuple(map(int, x)) for x in zip(*I.dyadic_runs(g, lo, hi))]
    want = []
    for k in range(3):
        pts = sorted({p for a, b, c in rows if a == k for p in range(b, c)})
        for p in pts:
            if want and want[-1][0] == k and want[-1][2] == p:
                want[-1] = (k, want[-1][1], p + 1)
            else:
                want.append((k, p, p + 1))
    assert got == want


def test_canonical_blocks_are_few_and_exact():
    g, s, lv = I.canonical_blocks(np.array([0]), np.array([1]), np.array([(1 << 28) - 1]))
    assert len(s) <= 2 * 28 and (1 << lv).sum() == (1 << 28) - 2


def brute(rows):
    out = set()
    for k in {r[0] for r in rows if r[0] is not None}:
        iv = sorted((a, b if b is not None else I.OPEN) for x, a, b in rows if x == k and a is not None)
        iv = [x for x in iv if x[1] > x[0]]
        cur = None
        for a, b in iv:
            if cur and a <= cur[1]:
                cur = (cur[0], max(cur[1], b))
            else:
                if cur:
                    out |= {(k, "period", *cur), (k, "gap", cur[1], a)}
                cur = (a, b)
        if cur:
            out.add((k, "period", cur[0], -1 if cur[1] == I.OPEN else cur[1]))
    return out


def test_periods_against_brute_force(spark):
    r = random.Random(4)
    day = 86_400_000
    rows = []
    for _ in range(600):
        a = r.choice([0, -3 * 10**12, 17 * 10**11]) + r.randrange(0, 400 * day, r.choice([1, day // 4, 1 << 28]))
        rows.append((r.choice(["hot", "hot", "a", "b", "c", None]), a if r.random() > 0.03 else None, None if r.random() < 0.01 else a + r.choice([0, -5, 1, day, 40 * day, 1 << 28, 1])))
    rows += rows[:40] + [("edge", 0, 1 << 28), ("edge", 1 << 28, 1 << 29), ("edge", (1 << 29) + 1, (1 << 29) + 2), ("open", 5, None), ("open", 1, 2)]
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    ts = lambda x: None if x is None else epoch + dt.timedelta(milliseconds=x)
    df = spark.createDataFrame([(k, ts(a), ts(b), 1, 2) for k, a, b in rows], "k string, a timestamp, b timestamp, slab int, lo int").repartition(5)
    got = {tuple(x) for x in I.periods_and_gaps(df, "k", "a", "b").collect()}
    assert got == brute(rows)
    assert I.periods_and_gaps(df.limit(0), "k", "a", "b").count() == 0


def test_rows_beyond_what_is_held_at_a_time(monkeypatch):
    """Columns marked as never null, as Spark sends them, and more rows than _HOLD, in one group or many."""
    monkeypatch.setattr(I, "_HOLD", 50)
    strict = pa.schema([("key", pa.string()), ("slab", pa.int64()), ("lo", pa.int64()), pa.field("hi", pa.int64(), nullable=False)])
    r = random.Random(5)
    for keys, width in (("k", 40), ("k", 3000), ("abcdef", 40), ("abcdef", 3000)):
        rows = [(r.choice(keys), r.choice([I.COARSE, 3, 4]), a := r.randrange(60_000), a + r.randrange(1, width)) for _ in range(1000)]
        batches = lambda rows: (pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 30])], schema=strict) for i in range(0, len(rows), 30))  # noqa: B023, E731
        near = [tuple(x.values()) for b in I._merge_near(batches(rows)) for x in b.to_pylist()]
        got = [tuple(x.values()) for b in I._merge_sorted(batches(sorted(near))) for x in b.to_pylist()]
        groups = {(k, s): [(0, a, b) for x, y, a, b in rows if (x, y) == (k, s)] for k, s, _, _ in rows}
        want = {(k, s, a, b) for (k, s), g in groups.items() for _, kind, a, b in brute(g) if kind == "period"}
        assert set(got) == want and len(got) == len(want)


def test_a_task_of_many_rows(spark):
    """One partition of 450,000 rows; keys by 1000, each with a period of a day on every second day, and its gaps."""
    day = 86_400_000
    df = spark.range(450_000).coalesce(1).selectExpr("cast(id % 1000 as string) k", f"timestamp_millis((id div 1000) * 2 * {day}) a", f"timestamp_millis(((id div 1000) * 2 + 1) * {day}) b")
    got = I.periods_and_gaps(df, "k", "a", "b").groupBy("row_kind").agg(F.count("*"), F.max("until_ms"), F.sum(F.col("until_ms") - F.col("from_ms"))).collect()
    assert {tuple(x) for x in got} == {("period", 450_000, 899 * day, 450_000 * day), ("gap", 449_000, 898 * day, 449_000 * day)}
