import datetime as dt
import json

from ledgerlark.streaming import streams as S

T0 = dt.datetime(2024, 1, 1, 12)


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(r) for r in rows))


def drain(q):
    q.awaitTermination(120)
    assert q.exception() is None


def test_first_copies_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    t = lambda m: (T0 + dt.timedelta(minutes=m)).isoformat()
    write(src, "1.json", [{"id": "a", "at": t(0)}, {"id": "b", "at": t(1)}, {"id": "a", "at": t(2)}])
    write(src, "2.json", [{"id": "b", "at": t(3)}, {"id": "c", "at": t(4)}])
    s = S.first_copies(S.follow(spark, str(src), "id string, at timestamp", 1), "id", "at")
    drain(s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_usage_windows(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [{"recorded_at": (T0 + dt.timedelta(minutes=m)).isoformat(), "action": "x", "status": 200 + 200 * (m > 50)} for m in (0, 10, 55, 70)] + [{"recorded_at": "2024-03-01T00:00:00", "action": "x", "status": 200}])
    s = S.usage_windows(S.follow(spark, str(src), "recorded_at timestamp, action string, status int"))
    q = s.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    drain(q)
    assert sorted((r["requests"], r["not_ok"]) for r in spark.table("hours").collect()) == [(1, 0), (1, 1), (3, 1)]


def test_budget_over_batches_equals_one_pass(spark, tmp_path):
    src, rows = tmp_path / "in", []
    for i, m in enumerate([0, 1, 2, 3, 4, 5, 50, 65, 70, 71, 200, 201, 202, 203]):
        rows.append({"principal_id": "p", "at": (T0 + dt.timedelta(minutes=m)).isoformat(), "digest": f"d{i % 9}", "revised": i == 10})
    write(src, "1.json", rows[:6])
    write(src, "2.json", rows[6:])
    s = S.prompt_budget(S.follow(spark, str(src), "principal_id string, at timestamp, digest string, revised boolean", 1))
    drain(s.writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).start())
    got = [r["decision"] for r in spark.table("budget").orderBy("at").collect()]
    hist, run, locks, want = [], 0, {}, []
    for r in rows:
        d, hist, run, locks = S.prompt_decision(hist, run, locks, dt.datetime.fromisoformat(r["at"]).timestamp(), r["digest"], r["revised"])
        want.append(d)
    assert got == want and got[:5] == ["granted"] * 3 + ["consecutive", "granted"] and "reissue-locked" in got and "hour-budget" in got


def test_touched_cohorts(spark, tmp_path):
    src = tmp_path / "in"
    write(src, "1.json", [{"k": "a"}, {"k": None}])
    ledger = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    drain(S.derive_touched(S.follow(spark, str(src), "k string"), lambda: ledger, "k", lambda d: d.groupBy("k").sum("v"), str(tmp_path / "out"), str(tmp_path / "cp")))
    assert [r["sum(v)"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [3]


def test_view_holds(spark):
    b = spark.createDataFrame([(dt.datetime(2024, 2, 1), None), (None, dt.datetime(2024, 3, 1))], "effective_from timestamp, expiry timestamp")
    assert S.view_holds(b, "2024-02-02", "2024-02-20") and not S.view_holds(b, "2024-02-20", "2024-01-01") and not S.view_holds(b, "2024-02-20", "2024-03-01")
