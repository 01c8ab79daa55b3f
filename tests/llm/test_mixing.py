import random

import pytest

from ledgerlark.llm import mixing as M


def leaf(source, lang, tokens, share, repeats):
    return M.Leaf(M.DOMAINS.get(source, "other"), lang, source, tokens, share, repeats)


def test_shortage_goes_to_siblings_before_other_domains():
    shares = {"chat_thread": 0.25, "codex_jsonl": 0.25, "document": 0.5}
    leaves = [leaf("chat_thread", "en", 100, 0.25, 1), leaf("codex_jsonl", "en", 10_000, 0.25, 1), leaf("document", "en", 10_000, 0.5, 1)]
    b = {x.source: v for x, v in M.budgets(leaves, shares, 2000).items()}
    assert b == pytest.approx({"chat_thread": 100, "codex_jsonl": 900, "document": 1000})
    b = {x.source: v for x, v in M.budgets([leaf("chat_thread", "en", 100, 0.25, 1), leaf("codex_jsonl", "en", 200, 0.25, 1), leaves[2]], shares, 2000).items()}
    assert b == pytest.approx({"chat_thread": 100, "codex_jsonl": 200, "document": 1700})


def test_languages_of_a_source_fill_up_each_other():
    b = {x.lang: v for x, v in M.budgets([leaf("document", "en", 100, 1.0, 3), leaf("document", "de", 300, 1.0, 3)], {"document": 1.0}, 1000).items()}
    assert sum(b.values()) == pytest.approx(1000) and b["en"] == pytest.approx(250)


def test_feasible_total_meets_every_share():
    shares = {"chat_thread": 0.5, "document": 0.3, "git_history": 0.2}
    leaves = [leaf("chat_thread", "en", 1000, 0.5, 1), leaf("document", "en", 300, 0.3, 2), leaf("git_history", "en", 900, 0.2, 2)]
    assert M.feasible_total(leaves, shares) == pytest.approx(2000, rel=1e-3)


def test_selection(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        s = r.choice(["chat_thread", "chat_thread", "chat_thread", "document", "git_history", "legacy_wiki", None])
        rows.append((i, r.choice(["", None, "one two three four " * r.randrange(1, 30)]) if r.random() < 0.1 else "one two three four " * r.randrange(1, 30), r.choice(["en", "EN", "en-GB", "de", None]), s, 5))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int").repartition(4)
    t = spark.createDataFrame([("chat_thread", 0.4, 1), ("document", 0.35, 3), ("git_history", 0.2, None), ("ticket_mirror", 0.05, 2), (None, 0.3, 1), ("document", 0.35, 3)], "source string, target_share double, max_repeats int")
    sel, rep = M.mix(d, t)
    sel, rep = sel.collect(), {x["source"]: x for x in rep.collect()}
    uses = {}
    for x in sel:
        uses.setdefault((x["source"], x["doc_id"]), []).append(x["epoch"])
    assert all(len(e) == len(set(e)) <= {"chat_thread": 1, "document": 3, "git_history": 1}[k[0]] for k, e in uses.items())
    # All sources that have tokens reach their target; the mirror's share, which nobody can give, is what they have above it.
    assert all(rep[k]["reached_share"] >= v - 0.01 for k, v in (("chat_thread", 0.4), ("document", 0.35), ("git_history", 0.2)))
    assert sum(max(0, rep[k]["reached_share"] - v) for k, v in (("chat_thread", 0.4), ("document", 0.35), ("git_history", 0.2))) <= 0.06
    assert rep["ticket_mirror"]["reached_share"] == 0 and rep["legacy_wiki"]["selected_tokens"] == 0
    assert sum(x["n_tokens"] for x in sel) == sum(x["selected_tokens"] for x in rep.values())
    again = M.mix(d.repartition(7), t)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, sel))
    fixed = M.mix(d, t, total_tokens=3000)[0].collect()
    assert 2700 <= sum(x["n_tokens"] for x in fixed) <= 3000


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    t = spark.createDataFrame([("document", 1.0, 1)], "source string, target_share double, max_repeats int")
    sel, rep = M.mix(d, t)
    assert sel.count() == 0 and rep.first()["reached_share"] == 0
    sel, rep = M.mix(spark.createDataFrame([(1, "a b", "en", "document")], d.schema), t.limit(0))
    assert sel.count() == 0 and rep.count() == 1
