import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlark.llm import packing as P
from ledgerlark.llm import tokens as K


def plain_best_fit(items, capacity, foes):
    bins = []
    for n, source, clusters in items:
        ok = [(b["free"], i) for i, b in enumerate(bins) if b["free"] >= n and not (b["clusters"] & clusters) and not any((source, s) in foes for s in b["sources"])]
        if ok:
            b = bins[min(ok)[1]]
        else:
            b = {"free": capacity, "clusters": set(), "sources": set()}
            bins.append(b)
        b["free"] -= n
        b["clusters"] |= clusters
        b["sources"].add(source)
    return sorted((b["free"], tuple(sorted(b["sources"]))) for b in bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 3), st.integers(0, 5)), max_size=60))
def test_bins_equal_an_exhaustive_best_fit(items):
    foes = {0: 1 << 1, 1: 1 << 0}
    bins = P.Bins(20, foes)
    got = {}
    for n, s, c in items:
        got.setdefault(bins.put(n, s, 1 << c), []).append((n, s))
    want = plain_best_fit([(n, s, {c}) for n, s, c in items], 20, {(0, 1), (1, 0)})
    assert sorted((20 - sum(n for n, _ in b), tuple(sorted({s for _, s in b}))) for b in got.values()) == want


def docs(spark, n=400):
    r = random.Random(2)
    rows = []
    for i in range(n):
        t = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(r.choice([3, 20, 60, 400])))
        rows.append((i, r.choice([t, t, "same text here", "", None]), r.choice(["issue_tracker", "ticket_mirror", "document", None]), r.choice([f"n{i % 50}", None]), 9))
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, native_id string, tokens int")


def test_every_token_lies_once_and_no_conflict_shares_a_container(spark):
    d = docs(spark).repartition(5)
    sizes = spark.createDataFrame([("s", 64), ("m", 256), ("s", 64), (None, 5), ("z", 0), ("n", None)], "container_kind string, capacity_tokens int")
    out = P.pack(d, sizes, shard_rows=150).collect()
    rows = {r["doc_id"]: r for r in d.collect()}
    want = {i: K.count(r["text"]) for i, r in rows.items() if r["text"]}
    for kind, cap in (("s", 64), ("m", 256)):
        mine = [r for r in out if r["container_kind"] == kind]
        by_doc, by_bin = {}, {}
        for r in mine:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_bin.setdefault(r["container_id"], []).append(r)
        assert {i: sum(r["tokens"] for r in x) for i, x in by_doc.items()} == want
        for i, x in by_doc.items():
            x.sort(key=lambda r: r["part"])
            assert [r["token_from"] for r in x] == [0, *[r["token_until"] for r in x[:-1]]]
            assert len(x) == 1 or want[i] > cap
        for x in by_bin.values():
            assert sum(r["tokens"] for r in x) <= cap
            names = [rows[r["doc_id"]]["native_id"] for r in x if rows[r["doc_id"]]["native_id"]]
            texts = [rows[r["doc_id"]]["text"] for r in x]
            assert len(names) == len(set(names)) and len(texts) == len(set(texts))
            assert not {"issue_tracker", "ticket_mirror"} <= {r["source"] for r in x}
    assert {r["container_kind"] for r in out} == {"s", "m"}


def test_little_space_is_unused_and_empty_tables(spark):
    r = random.Random(1)
    d = spark.createDataFrame([(i, " ".join("word" for _ in range(r.randrange(5, 120))), "s", f"n{i}") for i in range(600)], "doc_id bigint, text string, source string, native_id string").withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    sizes = spark.createDataFrame([("m", 512)], "container_kind string, capacity_tokens int")
    assert P.fill_report(P.pack(d, sizes)).first()["unused_share"] < 0.03
    assert P.pack(d.limit(0), sizes).count() == 0 and P.pack(d, sizes.limit(0)).count() == 0


def test_pieces_hold_the_same_tokens():
    t = ("lorem ipsum dolor, 12 sit\n\namet " * 3000) + "x" * 30_000 + " end of it"
    whole = K.encoding(K.TOKENIZER).encode_ordinary(t)
    assert sum((K.encoding(K.TOKENIZER).encode_ordinary(p) for p in K.pieces(t)), []) == whole
    assert "".join(K.pieces(t)) == t and K.count(None) == 0 and K.count("") == 0
