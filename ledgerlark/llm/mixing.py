"""Mixing sources to target weights of the total tokens.

Weights stand at the leaves of a tree of domains, languages and sources; a source's weight is spread over its languages as its
tokens are. A leaf can give its tokens as often as its source's max_repeats allows. Weights add up towards the root and budgets
are poured down: what a leaf can't give goes to the other sources of its language first, then to the other languages of the
domain, then to other domains. A source without tokens is a leaf without room, so its share takes the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlark.llm.tokens import TOKENIZER, with_tokens
from ledgerlark.session import cut

#: The domain of each source; others form the domain "other".
DOMAINS = {"chat_thread": "conversation", "codex_jsonl": "conversation", "pull_request": "work", "issue_tracker": "work", "ticket_mirror": "work", "git_history": "work", "document": "reference", "docs_adr": "reference", "legacy_wiki": "reference", "graph_export": "machine", "command_result": "machine"}
SEED = 20240101
#: Rounds in which the last epoch is filled.
PASSES = 5
#: They end when less than this share of the total is left.
LITTLE = 0.0002


@dataclass(frozen=True)
class Leaf:
    domain: str
    lang: str
    source: str
    tokens: int
    share: float
    repeats: int


def _pour(amount: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares ``amount`` by weight among parts of limited room; what one can't take goes to the others."""
    got = [0.0] * len(room)
    while amount > 1e-9:
        live = [i for i in range(len(room)) if room[i] - got[i] > 1e-9]
        total = sum(weights[i] for i in live)
        if not live or total <= 0:
            break
        given = [(i, min(amount * weights[i] / total, room[i] - got[i])) for i in live]
        for i, x in given:
            got[i] += x
        amount -= sum(x for _, x in given)
    return got


def budgets(leaves: list[Leaf], shares: dict[str, float], total: float) -> dict[Leaf, float]:
    """The tokens that each leaf gives."""
    held: dict[str, int] = {}
    for x in leaves:
        held[x.source] = held.get(x.source, 0) + x.tokens
    leaves = [x for x in leaves if x.share > 0 and x.tokens > 0]
    absent = [Leaf(DOMAINS.get(s, "other"), "", s, 0, w, 0) for s, w in shares.items() if not held.get(s)]
    weight = {x: shares[x.source] * x.tokens / held[x.source] for x in leaves} | {x: shares[x.source] for x in absent}
    room = {x: float(x.tokens * x.repeats) for x in weight}
    out: dict[Leaf, float] = {}

    def pour(parts: list[Leaf], amount: float, levels: tuple[str, ...]) -> None:
        if not levels:
            for x in parts:
                out[x] = amount
            return
        groups: dict[str, list[Leaf]] = {}
        for x in sorted(parts, key=lambda x: (x.domain, x.lang, x.source)):
            groups.setdefault(getattr(x, levels[0]), []).append(x)
        below = list(groups.values())
        got = _pour(amount, [sum(weight[x] for x in g) for g in below], [sum(room[x] for x in g) for g in below])
        for g, part in zip(below, got):
            pour(g, part, levels[1:])

    pour(list(weight), total, ("domain", "lang", "source"))
    return {x: b for x, b in out.items() if x.tokens}


def feasible_total(leaves: list[Leaf], shares: dict[str, float]) -> float:
    """The largest total at which every source that has tokens can give its share; shares of sources without any are left to
    others, and limit through these."""
    low, high = 0.0, float(sum(x.tokens * x.repeats for x in leaves if x.share > 0))

    def fits(total: float) -> bool:
        b = budgets(leaves, shares, total)
        given: dict[str, float] = {}
        for x, n in b.items():
            given[x.source] = given.get(x.source, 0) + n
        return abs(sum(b.values()) - total) < 1 and all(n >= shares[s] * total - 1e-6 for s, n in given.items())

    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if fits(mid) else (low, mid)
    return low


def _language(c):
    return F.coalesce(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})", 1), F.lit("und"))


@dataclass
class _Fill:
    """The last epoch of a leaf: ``full`` whole epochs lie before it; each pass took documents up to (tokens, order)."""

    full: int
    left: float
    passes: list[tuple[int, int]]
    taken: int = 0


def _chosen(fills: dict[tuple[str, str], _Fill], df: DataFrame) -> DataFrame:
    """``df`` (source, lang, n_tokens, _order) joined with its leaf's limits; ``_in``: some pass took the document. One row a leaf."""
    rows = [(s, g, f.full, int(f.left), [{"most": m, "upto": o} for m, o in f.passes]) for (s, g), f in fills.items()]
    limits = df.sparkSession.createDataFrame(rows, "source string, lang string, _full int, _left bigint, _passes array<struct<most bigint, upto bigint>>")
    return df.join(F.broadcast(limits), ["source", "lang"]).withColumn("_in", F.exists("_passes", lambda p: (F.col("n_tokens") <= p["most"]) & (F.col("_order") <= p["upto"])))


def _next_pass(fills: dict[tuple[str, str], _Fill], last: DataFrame) -> None:
    """Takes, in each leaf's order, the longest run of documents that each fit what is left and together too. Sums per bucket tell
    where it ends; only that bucket is sorted. What comes to the driver is one row a leaf."""
    rest = _chosen(fills, last).filter(~F.col("_in") & (F.col("n_tokens") <= F.col("_left"))).withColumn("_bucket", F.shiftright("_order", 53))
    line = W.partitionBy("source", "lang").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    sums = rest.groupBy("source", "lang", "_bucket", "_left").agg(F.sum("n_tokens").alias("_sum")).withColumn("_upto", F.sum("_sum").over(line))
    ends = sums.groupBy("source", "lang").agg(F.min(F.when(F.col("_upto") > F.col("_left"), F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_before")))).alias("e"), F.max("_upto").alias("_all"))
    inside = rest.join(F.broadcast(ends.filter("e is not null").select("source", "lang", "e.*")), ["source", "lang", "_bucket"])
    run = W.partitionBy("source", "lang").orderBy("_order", "n_tokens").rowsBetween(W.unboundedPreceding, 0)
    cut = inside.withColumn("_run", F.col("_before") + F.sum("n_tokens").over(run)).groupBy("source", "lang").agg(F.min(F.when(F.col("_run") > F.col("_left"), F.col("_order"))).alias("stop"), F.max(F.when(F.col("_run") <= F.col("_left"), F.col("_run"))).alias("got"))
    for r in ends.join(cut, ["source", "lang"], "left").select("source", "lang", "e", "_all", "stop", "got").collect():
        f = fills[r["source"], r["lang"]]
        f.passes.append((int(f.left), r["stop"] - 1 if r["stop"] is not None else (1 << 63) - 1))
        got = int(r["got"] if r["got"] is not None else r["e"]["_before"] if r["e"] is not None else r["_all"])
        f.left, f.taken = f.left - got, f.taken + got


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(selection, report). selection: doc_id, source, lang, epoch, n_tokens, one row per use of a document. report: a row per
    source with target_share, reached_share, tokens available and selected, and the mean repeats.

    total_tokens None: the largest total at which all sources that have tokens meet their targets. Each leaf gives whole epochs, and of the
    last one the prefix, in an order seeded by epoch and document, that fits its budget; documents too long for what is left
    are passed over, and what no document of a leaf fits goes to the source's leaf with most left (PASSES rounds). Sources
    without target (null ones too) aren't selected but reported with target 0; targets without documents are reported with 0
    reached; a null max_repeats counts as 1, one below 1 as never; a repeated target row counts once, the largest. Documents
    without tokens are not selected. Empty tables give empty results.
    """
    spark = documents.sparkSession
    lang = F.when(_language("lang") == "", "und").otherwise(_language("lang"))
    domain = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DOMAINS.items() for x in kv)), F.col("source")), F.lit("other"))
    docs = cut(with_tokens(documents.filter("doc_id is not null").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source"), lang.alias("lang"), "text"), "text", ["doc_id", "source", "lang"], tokenizer).filter("n_tokens > 0"))
    goal = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")).collect()}
    whole = sum(s for s, _ in goal.values()) or 1.0
    shares = {s: x / whole for s, (x, _) in goal.items()}
    # Leaves are few: sources times languages.
    stats = docs.groupBy(domain.alias("domain"), "lang", "source").agg(F.sum("n_tokens").alias("tokens")).collect()
    leaves = [Leaf(r["domain"], r["lang"], r["source"], r["tokens"], shares.get(r["source"], 0.0), max(0, goal[r["source"]][1]) if r["source"] in goal else 0) for r in stats]
    total = float(total_tokens) if total_tokens is not None else feasible_total(leaves, shares)
    plan = budgets(leaves, shares, total)
    fills = {(x.source, x.lang): _Fill(int(b // x.tokens), float(int(b - (b // x.tokens) * x.tokens)), []) for x, b in plan.items() if b >= 1}
    size = {(x.source, x.lang): x for x in leaves}
    limits = spark.createDataFrame([(s, g, f.full) for (s, g), f in fills.items()], "source string, lang string, _full int")
    # The order of the last epoch: 63 bits of a seeded hash.
    last = docs.join(F.broadcast(limits), ["source", "lang"]).withColumn("_order", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("_full"), F.col("doc_id")), 1)).drop("_full")
    for _ in range(PASSES):
        for s in {s for s, _ in fills}:  # what a leaf can't fill goes to the source's leaf with most left in its last epoch
            of = [k for k in fills if k[0] == s]
            most = max(of, key=lambda k: (size[k].tokens - fills[k].taken if fills[k].full < size[k].repeats else -1, k))
            for k in of:
                if k != most and fills[k].passes:
                    fills[most].left, fills[k].left = fills[most].left + fills[k].left, 0.0
        if sum(f.left for f in fills.values()) <= LITTLE * total:
            break
        _next_pass(fills, last)
    done = docs.join(F.broadcast(limits.filter("_full > 0")), ["source", "lang"]).select("doc_id", "source", "lang", F.explode(F.sequence(F.lit(0), F.col("_full") - 1)).alias("epoch"), "n_tokens")
    part = _chosen(fills, last).filter("_in").select("doc_id", "source", "lang", F.col("_full").alias("epoch"), "n_tokens")
    selection = done.unionByName(part)
    available = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    used = selection.groupBy("source").agg(F.sum("n_tokens").alias("selected_tokens"), F.max("epoch").alias("_e"))
    goals = spark.createDataFrame([(s, float(goal[s][0]), int(goal[s][1])) for s in goal], "source string, target_share double, max_repeats int")
    report = goals.join(available, "source", "full").join(used, "source", "left")
    taken = F.coalesce("selected_tokens", F.lit(0))
    report = report.select(
        "source",
        F.coalesce("target_share", F.lit(0.0)).alias("target_share"),
        F.coalesce(F.try_divide(taken, F.sum(taken).over(W.partitionBy())), F.lit(0.0)).alias("reached_share"),
        F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        taken.alias("selected_tokens"),
        F.coalesce(F.try_divide(taken, F.col("available_tokens")), F.lit(0.0)).alias("mean_repeats"),
        F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"),
        F.coalesce(F.col("_e") + 1, F.lit(0)).alias("epochs"),
    )
    return selection, report
