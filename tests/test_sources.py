import json

from ledgerlark.sources import adapters as A
from ledgerlark.sources import sinks as K


def put(tmp, name, *lines):
    p = tmp / name
    p.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(p)


def test_transcripts_and_bad_lines(spark, tmp_path):
    p = put(tmp_path, "s1.jsonl", {"type": "session_meta", "id": "m"}, {"id": "a", "timestamp": "2024-01-01T00:00:00Z", "payload": {"role": "user", "content": [{"type": "t", "text": "one"}, {"text": "two"}]}}, "not json", "[1]", "", {"type": "stop"}, {"type": "message", "message": {"role": "u", "content": "hi"}})
    rows = {r["native_id"]: r for r in A.scan(spark, "codex_jsonl", p).collect()}
    assert rows["s1/a"]["statement"] == "one\ntwo" and rows["s1/a"]["attributes"]["role"] == "user"
    assert rows["s1/line:6"]["disposition"] == "terminal" and rows["s1/line:7"]["statement"] == "hi"
    assert {r["problem"]: r["lines"] for r in A.problems(A.scan(spark, "codex_jsonl", p)).collect()} == {"not-json": 1, "not-object": 1}


def test_exports(spark, tmp_path):
    i = put(tmp_path, "i.jsonl", {"id": "1", "title": "t", "body": "b", "state": "completed", "creator_kind": "agent", "updated_at": "2024-01-01T00:00:00Z"}, {"title": "no id"})
    r = {x["native_id"]: x for x in A.scan(spark, "issue_tracker", i).collect()}
    assert (r["1"]["disposition"], r["1"]["provenance"], r["1"]["statement"]) == ("accepted", "ai_generated", "t\nb") and r[None]["problem"] == "missing-id"
    p = put(tmp_path, "p.jsonl", {"id": "7", "title": "t", "merged": True, "author_kind": "agent", "merged_by_kind": "human", "files": [{"path": "a.rs", "spans": [{"start": 1, "end": 2}, {"start": 0, "end": 4}]}, {"path": "b.rs"}]})
    x = A.scan(spark, "pull_request", p).first()
    assert (x["disposition"], x["provenance"], x["attributes"]["anchors"]) == ("accepted", "human_review", "a.rs:1-2")
    c = put(tmp_path, "c.jsonl", {"id": "t", "channel": "x", "started_at": "2024-01-01T00:00:00Z", "messages": [{"author": "a", "author_kind": "agent", "text": "hi", "ts": "2024-01-03T00:00:00Z"}, {"author": "b", "author_kind": "human", "text": "yo"}]})
    x = A.scan(spark, "chat_thread", c).first()
    assert (x["provenance"], x["statement"], x["confidence"], x["updated_at"].day) == ("human", "a: hi\nb: yo", 5000, 3)
    d = put(tmp_path, "d.jsonl", {"id": "d", "title": "t", "body": "é" * 20_000, "atom_kind": "invariant", "governs_paths": ["src"]}, {"id": "e", "title": "t", "atom_kind": "joke", "governs_paths": ["src"]})
    x = {r["native_id"]: r for r in A.scan(spark, "document", d).collect()}
    assert len(x["d"]["statement"].encode()) <= A.MAX_BYTES and x["d"]["statement"].endswith(A.EXCERPT) and x["d"]["attributes"]["governs"] == "src" and x["e"]["attributes"]["governs"] is None


def test_adr_results_answers(spark, tmp_path):
    (tmp_path / "adr").mkdir()
    (tmp_path / "adr" / "0001-x.md").write_text("---\nadr: 1\ntitle: Use it\nstatus: Accepted\nsupersedes: 0\n---\nBody here.\n")
    (tmp_path / "adr" / "0002-y.md").write_text("---\nadr: 2\nstatus: odd\n---\nBody.\n")
    r = {x["native_id"]: x for x in A.scan(spark, "docs_adr", str(tmp_path / "adr")).collect()}
    assert (r["0001-x"]["disposition"], r["0001-x"]["statement"], r["0001-x"]["attributes"]["supersedes"]) == ("accepted", "Use it\nBody here.", "0") and r["0002-y"]["problem"] == "missing-title"
    c = put(tmp_path, "r.jsonl", {"command": ["make", "test"], "exit_code": 2, "environment_id": "ci"})
    assert A.scan(spark, "command_result", c).first()["logical_key"] == "runtime_evidence:ci:make test"
    a = put(tmp_path, "a.jsonl", {"question_id": "q", "answer": "yes", "rationale": "so"})
    x = A.scan(spark, "authority_answer", a).first()
    assert x["native_id"].startswith("answer:") and x["attributes"]["scope"] == "architecture:company" and x["confidence"] == 9800


def test_commits_and_snapshots(spark, tmp_path):
    g = put(tmp_path, "g.jsonl", {"sha": "a", "parents": [], "tree": "T1", "author": "Bob", "subject": "s"}, {"sha": "b", "parents": ["a"], "tree": "T2", "author": "dependabot[bot]"}, {"sha": "c", "parents": ["b"], "tree": "T1", "trailers": "Co-authored: copilot"}, {"sha": "d", "parents": ["c", "b"], "tree": "T3"})
    r = {x["native_id"]: (x["disposition"], x["provenance"]) for x in A.scan(spark, "git_history", g).collect()}
    assert r == {"a": ("observed", "unknown"), "b": ("observed", "bot"), "c": ("reverted", "ai_generated"), "d": ("merged", "unknown")}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap" / "1.json").write_text(json.dumps({"exported_at": "2024-01-01T00:00:00Z", "issues": [{"number": 1, "title": "old", "state": "OPEN"}, {"number": 2, "title": "two", "state": "OPEN"}]}))
    (tmp_path / "snap" / "2.json").write_text(json.dumps({"exported_at": "2024-02-01T00:00:00Z", "issues": [{"number": 1, "title": "new", "state": "CLOSED"}], "pullRequests": [{"number": 1, "title": "p", "merged": True}]}))
    r = {x["native_id"]: (x["statement"], x["disposition"], x["present"]) for x in A.scan(spark, "export_snapshot", str(tmp_path / "snap")).collect()}
    assert r == {"issue:1": ("new", "closed", True), "issue:2": ("two", "open", False), "pr:1": ("p", "merged", True)}


def test_graph_code_and_tree(spark, tmp_path):
    n = spark.createDataFrame([("1", "active", "team", "n", "T", "C", "t"), ("1", "active", "team", "n", "Z", "C", "u"), ("2", "active", "private", "n", "T", "C", "t"), ("3", "archived", "team", "n", "T", "C", "t")], "id string, status string, audience string, node_type string, title string, content string, created_at string")
    e = spark.createDataFrame([("1", "9", "supersedes"), ("1", "8", "contradicts"), ("1", "7", "likes"), ("1", "9", "supersedes")], "src string, dst string, relationship string")
    rows = A.graph(n, e).collect()
    assert [(r["native_id"], r["statement"], r["supersedes"], r["contradicts"]) for r in rows] == [("1", "T\nC", ["9"], ["8"])]
    (tmp_path / "src").mkdir()
    for i in range(9):
        (tmp_path / "src" / f"f{i}.rs").write_text("pub fn run(a: u8) -> u8 {\n  if a { // x\n    1 }\n}\n" + ("pub struct Only;\n" if i == 0 else ""))
    s = A.scan(spark, "repo_symbols", str(tmp_path / "src")).collect()
    assert len({r["shape"] for r in s if r["name"] == "run"}) == 1 and len({r["logical_key"] for r in s if r["name"] == "run"}) == 9 and [r["logical_key"] for r in s if r["name"] == "Only"] == ["repo_symbols:Only"]
    assert "declares: run" in A.scan(spark, "repo_code", str(tmp_path / "src" / "f1.rs")).first()["statement"]
    import hashlib

    (tmp_path / "ev").mkdir()
    body = '{"a":1}'
    (tmp_path / "ev" / f"{hashlib.sha256(body.encode()).hexdigest()}.json").write_text(body)
    (tmp_path / "ev" / "odd.json").write_text(body)
    (tmp_path / "ev" / "bad.json").write_text("{")
    assert sorted(str(r["problem"]) for r in A.signed_tree(spark, str(tmp_path / "ev")).collect()) == ["None", "malformed", "misnamed"]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "ledger")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, v int")
    assert K.append_new(rows(("a", 1), ("a", 0), ("b", 2), (None, 3)), at, "id") == 2
    assert K.append_new(rows(("a", 9), ("c", 3)), at, "id") == 1 and K.append_new(rows(("c", 3)), at, "id") == 0
    assert {tuple(r) for r in spark.read.parquet(at).select("id", "v").collect()} == {("a", 0), ("b", 2), ("c", 3)}
    assert {tuple(r) for r in K.upsert(rows(("a", 1), ("b", 5)), rows(("a", 2), ("b", 4)), "id", "v").collect()} == {("a", 2), ("b", 5)}
    bad = spark.createDataFrame([("x", "p"), ("x", "p"), ("y", None)], "id string, problem string")
    assert K.quarantine(bad, ["id"]).count() == 1
    assert K.unexpired(spark.sql("select timestamp '2024-01-01' t union all select timestamp '2024-02-01'"), "t", "2024-02-02", 10).count() == 1
    i = spark.createDataFrame([("a", None, "line"), ("a", "b", "other")], "p string, q string, line string")
    assert len({r[0] for r in i.select(K.identity(i, ["p", "q"], "line")).collect()}) == 2


def test_indented_and_python_symbols(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def alone(x):\n    return x\n\nclass Box:\n    def inner(self):\n        pass\n    def _hidden(self):\n        pass\n    def x(self):\n        pass\ndefault = 1\n")
    (tmp_path / "src" / "b.rs").write_text("impl Box {\n    pub fn open(&self) {}\n\tpub async fn wait(&self) {}\n    fn own(&self) {}\n}\npub const LIMIT: u8 = 1;\n")
    (tmp_path / "src" / "c.ts").write_text("namespace N {\n  export const pay$ = 1;\n  export enum Kind {}\n}\nexport async function load() {}\n")
    got = {r["name"]: r["line"] for r in A.scan(spark, "repo_symbols", str(tmp_path / "src")).collect()}
    assert got == {"alone": 1, "Box": 4, "inner": 5, "open": 2, "wait": 3, "LIMIT": 6, "pay$": 2, "Kind": 3, "load": 5}


def test_lines_keep_their_numbers_across_blocks(spark, tmp_path):
    f = tmp_path / "big.jsonl"
    f.write_text("".join(f'{{"id": {i}}}\n' + ("\n" if i % 7 == 0 else "") for i in range(3000)))
    (tmp_path / "small.jsonl").write_text('{"id": 1}\r\n{"id": 2}')
    want = {(p.name, i, v) for p in tmp_path.iterdir() for i, v in enumerate(p.read_text(newline="").replace("\r\n", "\n").removesuffix("\n").split("\n"))}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {(r["path"].rsplit("/", 1)[1], r["line"], r["value"]) for r in A._lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_content_addressed_and_unchanged_views(spark, tmp_path):
    events = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "body string")
    at = f"{tmp_path}/store"
    K.content_addressed(events, "body", at)
    K.content_addressed(events, "body", at)
    assert spark.read.parquet(at).count() == 2
    view = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string")
    assert K.write_if_changed(view, f"{tmp_path}/view") and not K.write_if_changed(view.orderBy("v"), f"{tmp_path}/view")
    assert K.write_if_changed(view.filter("k = 1"), f"{tmp_path}/view") and spark.read.parquet(f"{tmp_path}/view").count() == 1
