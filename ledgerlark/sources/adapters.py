"""Source adapters: each reads native files and returns SOURCE_RECORD rows; unreadable lines are counted, not lost.

Common columns: source_kind, native_id, logical_key, statement, disposition, provenance, confidence, updated_at, attributes,
path, problem. A row with a problem has no statement.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.text import canonical

MAX_BYTES = 15_000
EXCERPT = " [excerpt; full source retained by content digest]"
# Markers of automated authors.
BOTS = ["dependabot", "renovate", "github-actions", "[bot]", "semantic-release"]
AGENTS = ["claude", "codex", "copilot", "cursor", "devin", "aider", "gpt-"]
ADR_STATES = ["accepted", "proposed", "rejected", "superseded"]
RULING_KINDS = ["north_star", "directional", "invariant", "decision", "constraint", "rationale"]


def bounded(c: Column) -> Column:
    """Text of at most MAX_BYTES bytes; a longer one is cut before the marker."""
    room = MAX_BYTES - len(EXCERPT)
    clean = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f\x7f-\x9f\x{061c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}]", " ")
    head = _head(clean, room)
    return F.when(F.octet_length(clean) <= MAX_BYTES, clean).otherwise(F.concat(head, F.lit(EXCERPT)))


def _head(c: Column, room: int) -> Column:
    @F.pandas_udf(T.StringType())
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode()[:room].decode("utf-8", "ignore"))

    return cut(F.when(F.octet_length(c) > MAX_BYTES, c))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its file and its number from 0 in it. Files are read in blocks, so one of any size is spread over tasks: a
    line's number is its place in its block plus the lines of the file's earlier blocks, of which there is one row each."""
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    blocks = read.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = read.join(blocks.select("path", "block", "first", before.alias("before")), ["path", "block"])
    return numbered.select("path", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("line"), "value")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parsed lines: path, line, value, j (struct) and problem: empty, not-json or not-object. Blank lines at the end of a
    file are no rows."""
    t = _lines(spark, path).filter(F.trim("value") != "")
    body = F.trim("value")
    problem = F.when(F.try_parse_json(body).isNull(), "not-json").when(~body.startswith("{"), "not-object")
    return t.select("path", "line", "value", F.from_json(body, schema).alias("j"), problem.alias("problem"))


def _record(df: DataFrame, kind: str, native: Column, key: Column, text: Column, disposition: Column, provenance: Column, confidence: Column | int, updated: Column, **attrs: Column) -> DataFrame:
    problem = F.coalesce(F.col("problem"), F.when(native.isNull() | (native == ""), "missing-id"))
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(kind).alias("source_kind"), native.alias("native_id"), key.alias("logical_key"), F.when(problem.isNull(), bounded(text)).alias("statement"), disposition.alias("disposition"), provenance.alias("provenance"),
        (F.lit(confidence) if isinstance(confidence, int) else confidence).alias("confidence"), updated.alias("updated_at"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("attributes"), "path", problem.alias("problem"),
    )


def actor(kind: Column) -> Column:
    return F.when(kind == "human", "human").when(kind == "agent", "ai_generated").when(kind == "bot", "bot").otherwise("unknown")


def transcripts(spark: SparkSession, path: str, kind: str = "codex_jsonl") -> DataFrame:
    j = json_lines(spark, path, "id string, uuid string, type string, timestamp string, payload struct<id:string,role:string,text:string,content:array<struct<type:string,text:string>>>, message struct<role:string,content:string>, role string, text string, content string")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    text = F.coalesce(F.array_join(F.transform("j.payload.content", lambda x: F.coalesce(x["text"], F.lit(""))), "\n"), F.col("j.payload.text"), F.col("j.message.content"), F.col("j.text"), F.col("j.content"))
    ident = F.coalesce("j.id", "j.uuid", "j.payload.id", F.concat(F.lit("line:"), F.col("line") + 1))
    end = F.col("j.type").isin("stop", "session_end")
    return _record(j, kind, F.concat_ws("/", stem, ident), F.concat(F.lit(f"{kind}:"), stem), text, F.when(end, "terminal").otherwise("observed"), F.lit("transcript"), 6000, F.try_to_timestamp("j.timestamp"), role=F.coalesce("j.payload.role", "j.message.role", "j.role"))


def issues(spark: SparkSession, path: str) -> DataFrame:
    j = json_lines(spark, path, "id string, title string, body string, state string, creator_kind string, created_at string, updated_at string, labels array<string>, url string")
    d = F.when(F.col("j.state").isin("completed", "done", "closed"), "accepted").when(F.col("j.state").isin("canceled", "cancelled"), "rejected").otherwise("proposed")
    return _record(j, "issue_tracker", F.col("j.id"), F.concat(F.lit("issue_tracker:"), F.col("j.id")), F.concat_ws("\n", "j.title", "j.body"), d, actor(F.col("j.creator_kind")), 6000, F.try_to_timestamp(F.coalesce("j.updated_at", "j.created_at")), url=F.col("j.url"), labels=F.array_join("j.labels", ","))


def pull_requests(spark: SparkSession, path: str) -> DataFrame:
    j = json_lines(spark, path, "id string, title string, body string, merged boolean, merge_commit string, author_kind string, merged_by_kind string, merged_at string, url string, files array<struct<path:string,spans:array<struct<start:int,end:int>>>>")
    a, m = F.col("j.author_kind"), F.col("j.merged_by_kind")
    prov = F.when(a == "human", "human").when((a == "agent") & (m == "human"), "human_review").when(a == "agent", "ai_generated").when(a == "bot", "bot").otherwise("unknown")
    spans = F.flatten(F.transform("j.files", lambda f: F.transform(F.filter(F.coalesce(f["spans"], F.array().cast("array<struct<start:int,end:int>>")), lambda s: (s["start"] > 0) & (s["end"] >= s["start"])), lambda s: F.concat(f["path"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))))
    return _record(j, "pull_request", F.col("j.id"), F.concat(F.lit("pull_request:"), F.col("j.id")), F.concat_ws("\n", "j.title", "j.body"), F.when(F.col("j.merged"), "accepted").otherwise("proposed"), prov, 6000, F.try_to_timestamp("j.merged_at"), url=F.col("j.url"), anchors=F.array_join(spans, ","))


def chat_threads(spark: SparkSession, path: str) -> DataFrame:
    """A whole thread is one record."""
    j = json_lines(spark, path, "id string, channel string, permalink string, started_at string, messages array<struct<author:string,author_kind:string,text:string,ts:string>>")
    kinds = F.transform("j.messages", lambda m: m["author_kind"])
    prov = F.when(F.forall(kinds, lambda k: k.isin("agent", "bot")), "ai_generated").when(F.exists(kinds, lambda k: k == "human"), "human").otherwise("unknown")
    text = F.array_join(F.transform("j.messages", lambda m: F.concat_ws(": ", m["author"], m["text"])), "\n")
    newest = F.greatest(F.try_to_timestamp("j.started_at"), F.array_max(F.transform("j.messages", lambda m: F.try_to_timestamp(m["ts"]))))
    return _record(j, "chat_thread", F.col("j.id"), F.concat(F.lit("chat_thread:"), F.col("j.id")), text, F.lit("proposed"), prov, 5000, newest, channel=F.col("j.channel"), url=F.col("j.permalink"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    j = json_lines(spark, path, "id string, title string, body string, author_kind string, atom_kind string, disposition string, governs_paths array<string>, url string, modified_at string")
    ruling = F.col("j.atom_kind").isin(*RULING_KINDS)
    return _record(j, "document", F.col("j.id"), F.concat(F.lit("document:"), F.col("j.id")), F.concat_ws("\n", "j.title", "j.body"), F.coalesce("j.disposition", F.lit("proposed")), actor(F.col("j.author_kind")), 6000, F.try_to_timestamp("j.modified_at"), atom_kind=F.when(ruling, F.col("j.atom_kind")).otherwise("claim"), governs=F.when(ruling, F.array_join("j.governs_paths", ",")))


def adrs(spark: SparkSession, path: str) -> DataFrame:
    """Decision records with front matter; ``adr`` and ``title`` are required."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    part = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?s)^---.*?^{k}:[ \t]*([^\n]*)".replace("(?s)", "(?sm)"), 1)), F.lit(""))
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    problem = F.when(~F.col("value").startswith("---"), "no-front-matter").when(part("adr").isNull(), "missing-adr").when(part("title").isNull(), "missing-title")
    status = F.when(F.lower(part("status")).isin(*ADR_STATES), F.lower(part("status"))).otherwise("proposed")
    body = F.regexp_extract("value", r"(?s)^---\n.*?\n---\n(.*)$", 1)
    return _record(t.withColumn("problem", problem), "docs_adr", stem, F.concat(F.lit("docs_adr:"), stem), F.concat_ws("\n", part("title"), F.regexp_replace(body, r"^\s+|\s+$", "")), status, F.lit("human"), 9000, F.lit(None).cast("timestamp"), adr=part("adr"), supersedes=part("supersedes"))


def command_results(spark: SparkSession, path: str, kind: str = "runtime_evidence") -> DataFrame:
    j = json_lines(spark, path, "schema string, command array<string>, exit_code int, stdout string, observed_at string, environment_id string, effective_until string, environment_owner string")
    cmd, env = F.array_join("j.command", " "), F.coalesce("j.environment_id", F.lit("local"))
    d = F.when(F.col("j.exit_code") == 0, "passed").when(F.col("j.exit_code").isNotNull(), "failed").otherwise("observed")
    return _record(j, kind, F.concat_ws(":", env, cmd), F.concat_ws(":", F.lit(kind), env, cmd), F.concat(cmd, F.lit(" -> "), d), d, F.lit("human"), 9000, F.try_to_timestamp("j.observed_at"), owner=F.col("j.environment_owner"), until=F.col("j.effective_until"))


def commit_provenance(author: Column, email: Column, trailers: Column) -> Column:
    """Bot and agent marks; otherwise unknown, never human."""
    who = F.lower(F.concat_ws(" ", author, email))
    has = lambda c, marks: F.exists(F.array(*map(F.lit, marks)), lambda m: F.contains(c, m))
    return F.when(has(who, BOTS), "bot").when(has(F.lower(F.concat_ws(" ", author, email, trailers)), AGENTS), "ai_generated").otherwise("unknown")


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Exported commits; a revert restores the tree of its grandparent, found by two self-joins."""
    c = spark.read.schema("sha string, parents array<string>, tree string, author_date string, author string, email string, trailers string, subject string, paths array<string>").json(path).filter("sha is not null")
    p = c.select(F.col("sha").alias("p1"), F.try_element_at("parents", F.lit(1)).alias("p2"))
    g = c.select(F.col("sha").alias("p2"), F.col("tree").alias("old_tree"))
    x = c.withColumn("p1", F.try_element_at("parents", F.lit(1))).join(p, "p1", "left").join(g, "p2", "left").withColumn("problem", F.lit(None).cast("string")).withColumn("path", F.lit(path))
    kind = F.when(F.coalesce(F.col("tree") == F.col("old_tree"), F.lit(False)), "reverted").when(F.size("parents") >= 2, "merged").otherwise("observed")
    return _record(x, "git_history", F.col("sha"), F.concat(F.lit("git_history:"), F.col("sha")), F.col("subject"), kind, commit_provenance(F.col("author"), F.col("email"), F.col("trailers")), 6000, F.try_to_timestamp("author_date"), anchors=F.array_join(F.slice("paths", 1, 32), ","))


def export_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots of issues and pull requests: the newest snapshot's reading of each number; ``present`` as the newest one says."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.from_json("value", "exported_at string, issues array<struct<number:bigint,title:string,state:string,body:string,updatedAt:string>>, pullRequests array<struct<number:bigint,title:string,state:string,merged:boolean,body:string,updatedAt:string>>").alias("j"))
    at = F.coalesce(F.try_to_timestamp("j.exported_at"), F.col("mtime"))
    iss = t.select("path", at.alias("at"), F.lit("issue").alias("kind"), F.explode("j.issues").alias("x")).select("path", "at", "kind", "x.number", "x.title", "x.body", F.lower("x.state").alias("disposition"))
    prs = t.select("path", at.alias("at"), F.lit("pr").alias("kind"), F.explode("j.pullRequests").alias("x")).select("path", "at", "kind", "x.number", "x.title", "x.body", F.when(F.col("x.merged"), "merged").when(F.lower("x.state") == "closed", "rejected").otherwise("proposed").alias("disposition"))
    both = iss.unionByName(prs).filter("number is not null")
    last = both.groupBy("kind", "number").agg(F.max(F.struct("at", "path", "title", "body", "disposition")).alias("r"))
    top = t.agg(F.max(F.struct(at.alias("at"), "path")).alias("m")).first()["m"]
    native = F.concat_ws(":", "kind", F.col("number").cast("string"))
    return last.select(F.lit("export_snapshot").alias("source_kind"), native.alias("native_id"), bounded(F.concat_ws("\n", "r.title", "r.body")).alias("statement"), "r.disposition", ((F.col("r.at") == F.lit(top["at"])) & (F.col("r.path") == F.lit(top["path"]))).alias("present")) if top else last.select(F.lit("").alias("source_kind"), native.alias("native_id"), F.lit("").alias("statement"), F.lit("").alias("disposition"), F.lit(False).alias("present"))


def graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that are active or open questions and not private, with what they supersede and contradict; the first row of an id
    counts."""
    n = nodes.filter("id is not null and status in ('active', 'open-question') and audience in ('team', 'public')").groupBy("id").agg(F.min(F.struct("created_at", "title", "content", "node_type")).alias("r")).select("id", "r.*")
    e = edges.filter("relationship in ('supersedes', 'contradicts')").groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set(F.when(F.col("relationship") == "supersedes", F.col("dst")))).alias("supersedes"), F.array_sort(F.collect_set(F.when(F.col("relationship") == "contradicts", F.col("dst")))).alias("contradicts"))
    return n.join(e, "id", "left").select(F.lit("graph_export").alias("source_kind"), F.col("id").alias("native_id"), F.concat(F.lit("graph:"), F.col("id")).alias("logical_key"), bounded(F.concat_ws("\n", "title", "content")).alias("statement"), F.col("node_type").alias("atom_kind"), "supersedes", "contradicts")


def code_files(spark: SparkSession, path: str) -> DataFrame:
    """What each source file declares."""
    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    decl = F.regexp_extract_all("value", F.lit(r"(?m)^(?:pub |export |public )?(?:async )?(?:fn|def|class|struct|enum|trait|interface|function|type|const) +([A-Za-z_][A-Za-z0-9_]*)"), 1)
    lines = F.size(F.split("value", "\n"))
    text = F.concat(F.col("path"), F.when(F.size(decl) > 0, F.concat(F.lit(" declares: "), F.array_join(decl, "; "))).otherwise(F.concat(F.lit(" ("), lines.cast("string"), F.lit(" lines)"))))
    return _record(t.withColumn("problem", F.lit(None).cast("string")), "repo_code", F.col("path"), F.concat(F.lit("repo_code:"), F.col("path")), text, F.lit("observed"), F.lit("unknown"), 9000, F.lit(None).cast("timestamp"))


# Folders of other people's code, languages that are read, and paths of tests.
_VENDORED = r"(?:^|/)(?:node_modules|target|\.venv|venv|site-packages|\.next|build|coverage|\.cache)/"
_LANGUAGES = r"\.(?:ts|tsx|js|jsx|rs|py|go)$"
_TESTS = r"__tests__|/tests?/|\.(?:spec|test)\.ts$|_test\.go$|(?:^|/)test_[^/]*$|\.d\.ts$"


def declaration_shape(text: str, start: int, limit: int = 200) -> str:
    """The brace-balanced declaration from a line on, comments stripped and white space folded."""
    depth, seen, out = 0, False, []
    for line in text.split("\n")[start : start + limit]:
        line = line.split("//")[0]
        out.append(line)
        depth += line.count("{") - line.count("}")
        seen |= "{" in line
        if (seen and depth <= 0) or (not seen and line.rstrip().endswith(";")):
            break
    return " ".join(" ".join(out).split())


def code_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Exported declarations, indented ones and Python's included, with the digest of their shape; a name in more than eight files is keyed per file."""
    import hashlib
    import re

    declared = re.compile(r"\s*(?:export (?:async function|function|class|interface|type|const|enum)|pub (?:async fn|fn|struct|enum|trait)|def|class) ([\w$]*)")
    exported = re.compile(r"^(?:pub(?:\([a-z]+\))? |export (?:default )?|public )(?:async |static |abstract )*(?:fn|class|struct|enum|trait|interface|function|type|const|def) +([A-Za-z_]\w*)")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for p, text in zip(pdf["path"], pdf["value"]):
                for i, line in enumerate(text.split("\n")):
                    m = declared.match(line)
                    if m and (len(m[1].encode()) < 2 or m[1].startswith("_")):
                        continue  # not meant for others, or too short to be a subject
                    if m := m or exported.match(line):
                        rows.append((p, m[1], i + 1, hashlib.sha256(declaration_shape(text, i).encode()).hexdigest()[:16]))
            yield pd.DataFrame(rows, columns=["path", "name", "line", "shape"])

    t = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").filter(~F.col("path").rlike(_VENDORED) & F.col("path").rlike(_LANGUAGES) & ~F.col("path").rlike(_TESTS))
    s = t.mapInPandas(run, "path string, name string, line int, shape string")
    n = s.groupBy("name").agg(F.countDistinct("path").alias("files"))
    return s.join(n, "name").select("path", "name", "line", "shape", F.when(F.col("files") > 8, F.concat_ws(":", F.lit("repo_symbols"), "path", "name")).otherwise(F.concat_ws(":", F.lit("repo_symbols"), "name")).alias("logical_key"))


def authority_answers(spark: SparkSession, path: str) -> DataFrame:
    j = json_lines(spark, path, "question_id string, authority_id string, authority_scope string, answer string, rationale string, answered_at string, signer string, signature string")
    native = F.when(F.col("j.question_id").isNotNull(), F.concat(F.lit("answer:"), F.substring(F.sha2(F.coalesce(canonical(F.col("value")), F.col("value")), 256), 1, 16)))
    return _record(j, "authority_answer", native, F.concat(F.lit("authority_answer:"), F.col("j.question_id")), F.concat_ws("\n", "j.answer", "j.rationale"), F.lit("answered"), F.lit("human"), 9800, F.try_to_timestamp("j.answered_at"), scope=F.coalesce("j.authority_scope", F.lit("architecture:company")), signer=F.col("j.signer"))


def signed_tree(spark: SparkSession, path: str, limit: int = 64 * 1024) -> DataFrame:
    """Content-addressed event files: path, digest, and problem for oversized, unreadable or misnamed ones."""
    b = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    digest = F.sha2("content", 256)
    text = F.decode("content", "UTF-8")
    problem = F.when(F.col("length") > limit, "oversized").when(F.try_parse_json(text).isNull(), "malformed").when(~F.contains(F.col("path"), F.substring(digest, 1, 16)), "misnamed")
    return b.select("path", digest.alias("digest"), F.when(problem.isNull(), text).alias("event"), problem.alias("problem"))


def problems(records: DataFrame) -> DataFrame:
    """Lines left out, by reason."""
    return records.filter("problem is not null").groupBy("problem").agg(F.count("*").alias("lines"))


def source_digest(records: DataFrame) -> DataFrame:
    """One digest per unit of sorted native_id:digest lines; a unit is a file, whose lines one task can hold."""
    line = F.concat_ws(":", "native_id", F.sha2(F.coalesce("statement", F.lit("")), 256))
    return records.filter("native_id is not null").groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


SCANS: dict[str, Callable] = {"codex_jsonl": transcripts, "claude_jsonl": lambda s, p: transcripts(s, p, "claude_jsonl"), "issue_tracker": issues, "pull_request": pull_requests, "chat_thread": chat_threads, "document": documents, "docs_adr": adrs, "command_result": command_results, "git_history": commits, "export_snapshot": export_snapshots, "repo_code": code_files, "repo_symbols": code_symbols, "authority_answer": authority_answers, "signed_tree": signed_tree}


def scan(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """The adapter of a kind of source."""
    if kind not in SCANS:
        raise ValueError(f"unknown source kind {kind}")
    return SCANS[kind](spark, path)
