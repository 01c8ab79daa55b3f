"""Budgeted context selection: the greedy choice of facts by marginal value, within an item and a byte budget.

Features and an upper bound of each candidate's value are computed where it lies; the sequential rounds run over the rows of
the highest bounds only, are repeated over more rows whenever a row left out might have been chosen, and beyond a bounded
number of rows run in Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import text as X
from ledgerlark.session import cut

# Budgets and gains of the projection.
ITEMS, BYTES, DIRECTION_ITEMS = 32, 128 * 1024, 16
COMPLEMENT, COST = 2500, 250
EVIDENCE = {"observation": "evidence", "test": "evidence", "runtime": "evidence", "rationale": "explanation", "constraint": "explanation", "decision": "explanation"}
PRIORITY = {"constraint": 5, "decision": 4, "rationale": 3, "observation": 2, "claim": 1}


def _case(c: Column, table: dict, other) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(other)


def candidates(facts: DataFrame, task: str, decision: str, relevance: DataFrame) -> DataFrame:
    """Features of candidate facts. ``facts``: fact_id, logical_key, statement, atom_kind, store_kind, authority_scope, loss,
    confidence, independent, support (array), trigger. ``relevance``: statement, bp. Null statements aren't candidates; of
    equal fact_ids the least row counts."""
    f = facts.filter("statement is not null and fact_id is not null").groupBy("fact_id").agg(F.min(F.struct(*[c for c in facts.columns if c != "fact_id"])).alias("r")).select("fact_id", "r.*")
    f = f.join(relevance, "statement", "left").withColumn("bp", F.coalesce("bp", F.lit(2000)))
    t = X.terms(F.col("statement"))
    f = f.withColumns({"terms": t, "distinct_terms": F.filter(t, lambda w: F.octet_length(w) >= 4), "norm": F.lower(F.trim(F.regexp_replace("statement", r"\s+", " "))), "subject": X.key_subject(F.col("logical_key")), "class": _case(F.col("atom_kind"), EVIDENCE, None), "bytes": F.octet_length("statement") + 200})
    own = X.terms(F.coalesce("trigger", F.lit("")))
    about = F.size(F.array_intersect(own, F.array_union(X.terms(F.lit(task)), X.terms(F.lit(decision))))) > 0
    full = (F.size(own) > 0) & (F.size(F.array_except(own, t)) == 0) & about
    base = F.when(F.col("authority_scope").startswith("architecture") | (F.col("store_kind") == "company"), 800).otherwise(300)
    return f.withColumns({
        "coverage": F.when(full, F.col("loss")).otherwise(F.expr("loss * bp div 10000")).cast("bigint"),
        "gain": base + F.least(F.expr("coalesce(confidence, 0) div 20"), F.lit(500)),
        "uncertainty": F.least(F.coalesce("independent", F.lit(0)) * 250, F.lit(1000)),
        "protected": (F.coalesce(F.col("loss"), F.lit(0)) >= 7000) & F.col("atom_kind").isin("constraint", "decision"),
        "priority": _case(F.col("atom_kind"), PRIORITY, 0),
        "direction": F.col("store_kind") == "company",
    })


class _Fold:
    """What the selected facts mean for one candidate; absorbing one more fact is cheap."""

    __slots__ = ("row", "terms", "distinct", "support", "covered", "complement", "edge", "lexical")

    def __init__(self, row):
        self.row, self.terms, self.distinct, self.support = row, set(row["terms"]), set(row["distinct_terms"]), {x for x in row["support"] or [] if x is not None}
        self.covered = self.complement = False
        self.edge, self.lexical = None, 0

    def absorb(self, other: "_Fold") -> None:
        r, s = self.row, other.row
        self.covered |= r["logical_key"] == s["logical_key"] or r["norm"] == s["norm"]
        joint = r["class"] is not None and s["class"] is not None and r["class"] != s["class"]
        self.complement |= joint and ((r["subject"] == s["subject"] and r["logical_key"] != s["logical_key"]) or len(self.distinct & other.distinct) >= 2)
        if self.edge is None and self.support & other.support:
            self.edge = 1000 if r["protected"] else 3000
        if total := len(self.terms) + len(other.terms):
            same = len(self.terms & other.terms) * 20_000 // total
            if same >= 6000:
                self.lexical = max(self.lexical, min(same, 2000 if r["protected"] or joint else 10_000))

    def marginal(self) -> int:
        r = self.row
        return (0 if self.covered else r["coverage"] or 0) + r["gain"] + COMPLEMENT * self.complement + r["uncertainty"] - (self.lexical if self.edge is None else self.edge) - COST


def greedy(rows: list, items: int, limit: int, excluded: int | None) -> list[tuple[int, str, int]] | None:
    """The selection from ``rows``, or None if a candidate left out, worth ``excluded`` at most, could have been taken."""
    left = [_Fold(r) for r in rows]
    out: list[tuple[int, str, int]] = []
    used, direction = 2, 0
    while len(out) < items:
        fit = [f for f in left if f.row["bytes"] + used <= limit and not (direction >= DIRECTION_ITEMS and f.row["direction"])]
        best = min(fit, key=lambda f: (-f.marginal(), -f.row["priority"], f.row["fact_id"]), default=None)
        value = best.marginal() if best else 0
        if excluded is not None and value <= excluded and excluded > 0:
            return None
        if value <= 0:
            break
        out.append((len(out), best.row["fact_id"], value))
        used += best.row["bytes"] + 1
        direction += bool(best.row["direction"])
        left.remove(best)
        for f in left:
            f.absorb(best)
    return out


def _rounds(cands: DataFrame, items: int, limit: int) -> list[tuple[int, str, int]]:
    """The same choice with every round over all candidates where they lie: a task returns its best one, given the picks so far."""
    out: list[tuple[int, str, int]] = []
    picks: list[_Fold] = []
    schema = T.StructType([*cands.schema.fields, T.StructField("marginal", T.LongType())])
    order = lambda r: (-r["marginal"], -r["priority"], r["fact_id"])

    def best_of(taken: list[_Fold], room: int, directed: bool):
        chosen = {p.row["fact_id"] for p in taken}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, kept = None, None
            for b in batches:
                kept = b.schema
                for r in b.to_pylist():
                    if r["bytes"] > room or (directed and r["direction"]) or r["fact_id"] in chosen:
                        continue
                    f = _Fold(r)
                    for p in taken:
                        f.absorb(p)
                    r["marginal"] = f.marginal()
                    best = r if best is None or order(r) < order(best) else best
            if best is not None:
                yield pa.RecordBatch.from_pylist([best], schema=kept.append(pa.field("marginal", pa.int64())))

        return run

    while len(out) < items:
        room = limit - 2 - sum(p.row["bytes"] + 1 for p in picks)
        directed = sum(bool(p.row["direction"]) for p in picks) >= DIRECTION_ITEMS
        found = [r.asDict() for r in cands.mapInArrow(best_of(list(picks), room, directed), schema).collect()]  # one row a task
        best = min(found, key=order, default=None)
        if best is None or best["marginal"] <= 0:
            break
        out.append((len(out), best["fact_id"], best["marginal"]))
        picks.append(_Fold(best))
    return out


def select(cands: DataFrame, items: int = ITEMS, limit: int = BYTES, shortlist: int = 2000, most: int = 32_000) -> DataFrame:
    """(position, fact_id, marginal): ties go to the higher role priority, then the smaller fact_id; selection ends when
    nothing fits or adds value.

    No candidate can be worth more than its own features plus the complement gain. Spark finds the ``shortlist`` rows of the
    highest such bound; the greedy rounds over them are exact as long as each pick beats the bound of the best row left out.
    If one doesn't, the list is four times as long next time, and beyond ``most`` rows the rounds run over all candidates in
    Spark. So the result never depends on the list's length, and the driver never holds more than ``most`` rows.
    """
    spark = cands.sparkSession
    bound = F.coalesce("coverage", F.lit(0)) + F.col("gain") + COMPLEMENT + F.col("uncertainty") - COST
    ranked = cut(cands.withColumn("bound", bound))
    while True:
        rows = ranked.orderBy(F.desc("bound"), F.desc("priority"), "fact_id").limit(shortlist + 1).collect()  # a bounded list
        got = greedy(rows[:shortlist], items, limit, rows[shortlist]["bound"] if len(rows) > shortlist else None)
        if got is not None:
            return spark.createDataFrame(got, "position int, fact_id string, marginal bigint")
        shortlist *= 4
        if shortlist > most:
            return spark.createDataFrame(_rounds(ranked, items, limit), "position int, fact_id string, marginal bigint")


def array_cost(parts: list[str]) -> int:
    """Bytes of a JSON array of texts."""
    return sum(len(json.dumps(p, ensure_ascii=False).encode()) for p in parts) + max(0, len(parts) - 1) + 2
