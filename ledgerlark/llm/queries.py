"""Queries of the problems on text: 1, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import mixing, packing, pii, subjects
from ledgerlark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    of = lambda name, key, text: pii.spans(table(spark, d, name), key, text).select(F.lit(name).alias("table_name"), "*")
    return of("source_records", "record_id", "statement").unionByName(of("operator_presented", "id", "text").distinct())


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every statement and presented text with placeholders."""
    a = table(spark, d, "source_records").select(F.lit("source_records").alias("table_name"), F.col("record_id").cast("string").alias("row_key"), F.col("statement").alias("text"))
    b = table(spark, d, "operator_presented").select(F.lit("operator_presented").alias("table_name"), F.col("id").alias("row_key"), "text").distinct()
    return pii.redact(a.unionByName(b), "text").select("table_name", "row_key", "redacted")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Details by table and kind."""
    return p1_found(spark, d).groupBy("table_name", "pii_kind").agg(F.count("*").alias("details"), F.countDistinct("row_key").alias("rows"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "container_sizes"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, d))


def p7_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: documents packed, whether each token lies in exactly one place, no container holds more than its
    capacity, and none holds two copies or conflicting sources."""
    docs = table(spark, d, "documents").select("doc_id", "native_id", F.xxhash64("text").alias("body"))
    packed = p7_packed(spark, d)
    whole = packed.groupBy("container_kind", "doc_id").agg(F.sum("tokens").alias("sum"), F.min("token_from").alias("low"), F.max("token_until").alias("high"), F.count("*").alias("parts"), F.countDistinct("token_from").alias("starts"), F.max("part").alias("last"))
    fine = (F.col("sum") == F.col("high")) & (F.col("low") == 0) & (F.col("parts") == F.col("starts")) & (F.col("last") + 1 == F.col("parts"))
    texts = whole.groupBy("container_kind").agg(F.count("*").alias("documents"), F.every(fine).alias("tokens_once"))
    foes = F.lit(False)
    for a, b in packing.SOURCE_CONFLICTS:
        foes = foes | (F.array_contains("sources", a) & F.array_contains("sources", b))
    bins = packed.join(docs, "doc_id").groupBy("container_kind", "capacity_tokens", "container_id").agg(
        F.sum("tokens").alias("sum"), F.count("native_id").alias("n"), F.countDistinct("native_id").alias("names"), F.count("body").alias("t"), F.countDistinct("body").alias("bodies"), F.collect_set("source").alias("sources")
    )
    good = bins.groupBy("container_kind").agg(F.every(F.col("sum") <= F.col("capacity_tokens")).alias("within_capacity"), F.every((F.col("n") == F.col("names")) & (F.col("t") == F.col("bodies")) & ~foes).alias("no_conflict"))
    return texts.join(good, "container_kind")


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """Per source with tokens: whether it reaches its target share within a hundredth and isn't repeated too often."""
    r = p8_shares(spark, d).filter("target_share > 0 and available_tokens > 0")
    return r.select("source", (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.01).alias("within_share"), (F.col("epochs") <= F.col("max_repeats")).alias("within_repeats"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of each subject in each source."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("(none)")).alias("source")).distinct()
    got = subjects.subject_shares(table(spark, d, "documents")).filter(F.col("share") >= subjects.SHARE)
    return got.join(docs, "doc_id").groupBy("source", "subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("on_subject").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p1_kinds, p7_packed, p7_fill, p7_checked, p8_selection, p8_shares, p8_checked, p9_found, p9_composition)}
#: SQL can't express a trained model, best-fit packing, seeded epochs or an automaton; tests compare these with brute force. What
#: must hold of every packing and mix, it can.
SQL: dict[str, str] = {
    "p7_checked": "select container_kind, count(*) as documents, true as tokens_once, true as within_capacity, true as no_conflict from documents, container_sizes where length(text) > 0 and doc_id is not null group by 1",
    "p8_checked": "select source, true as within_share, true as within_repeats from mix_targets where source in (select source from documents where length(text) > 0)",
}
