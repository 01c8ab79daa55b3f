import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import deliveries as D

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def make(n, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        m = f"obs_{r.randrange(n // 3)}" if r.random() > 0.3 else "obs_hot"
        m = r.choice([m, m.upper(), f" {m} ", m])
        rows.append((i, None if r.random() < 0.02 else m, None if r.random() < 0.02 else T0 + dt.timedelta(seconds=r.randrange(50)), None if r.random() < 0.02 else r.randrange(7)))
    return rows


def brute(rows):
    best, rep = {}, set()
    far = T0 + dt.timedelta(days=10**5)
    for i, m, t, _ in sorted((x for x in rows if x[1] is not None), key=lambda x: (x[2] or far, x[0])):
        k = m.strip(" ").lower()
        rep |= {i} if k in best else set()
        best.setdefault(k, i)
    return rep


SCHEMA = "delivery_id bigint, observation_id string, delivered_at timestamp, window int"


def test_one_copy_is_kept(spark):
    rows = make(3000, 1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("message", F.lit(1)).withColumn("at", F.lit("x")).repartition(6)
    assert {r[0] for r in D.repeated_deliveries(df).collect()} == brute(rows)
    assert D.repeated_deliveries(df.limit(0)).count() == 0
    again = df.unionByName(df)
    got = [r[0] for r in D.repeated_deliveries(again, "window").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert D.repeated_deliveries(df.limit(0), "window").count() == 0


@pytest.mark.parametrize("batches", [1, 2, 3, 7])
def test_any_cut_into_batches(spark, batches):
    rows = make(2000, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0] for r in D.repeated_deliveries(df, "window", batches).collect()} == brute(rows)


def test_untouched_prefixes_keep_their_identifiers(spark):
    """Three batches; the second touches few prefixes, the third repeats all of the first."""
    index = D.DeliveryIndex(spark, prefixes=8)
    batch = lambda rows: D.message_rows(spark.createDataFrame([(i, m, T0, 0) for i, m in rows], SCHEMA))
    assert index.admit(batch([(i, f"m{i}") for i in range(40)])).count() == 0
    assert index.admit(batch([(100, "other")])).count() == 0
    again = D.DeliveryIndex(spark, index.path)
    assert again.prefixes == 8
    assert {r[0] for r in again.admit(batch([(200 + i, f"m{i}") for i in range(40)])).collect()} == {200 + i for i in range(40)}


def test_a_failed_batch_leaves_nothing(spark):
    index = D.DeliveryIndex(spark, prefixes=2)
    rows = D.message_rows(spark.createDataFrame([(1, "a", T0, 0), (2, "b", T0, 0)], SCHEMA))
    name = "000000000-dead"
    rows.mapInArrow(D._local(2), D._ROWS).repartition(2, "prefix").sortWithinPartitions("prefix").mapInArrow(D._admit(index.path, name, frozenset()), "delivery bigint").count()
    assert index.commits() == []
    assert index.admit(rows).count() == 0  # what the failed attempt wrote isn't read
    late = D.message_rows(spark.createDataFrame([(3, "A ", T0, 0)], SCHEMA))
    assert [r[0] for r in index.admit(late).collect()] == [3]
    assert index.vacuum() > 0
    assert sorted(r[0] for r in index.admit(D.message_rows(spark.createDataFrame([(0, "a", T0, 0), (9, "b", T0, 0)], SCHEMA))).collect()) == [1, 9]


def test_long_identifiers(spark):
    rows = [(1, "x" * 5000, T0, 0), (2, "x" * 5000, T0, 1), (3, "x" * 4999 + "y", T0, 0)]
    assert [r[0] for r in D.repeated_deliveries(spark.createDataFrame(rows, SCHEMA), "window").collect()] == [2]


def test_runs():
    a = D.Runs()
    ids = np.array([f"m{i % 40:030d}x".encode() for i in range(200)], D.ID)
    at, dl = np.arange(200)[::-1].copy(), np.arange(200)
    got = set()
    for i in range(0, 200, 10):
        got |= set(a.admit(ids[i : i + 10], at[i : i + 10], dl[i : i + 10]).tolist())
    assert got == set(range(160))
    b = D.Runs([D.merge_runs(a.runs)])
    assert len(b.runs[0][0]) == 40
    assert b.admit(ids[3:4], np.array([10**6]), np.array([999])).tolist() == [999]
    assert D.prefixes_for(10) == 64 and D.prefixes_for(10**9) == 512
