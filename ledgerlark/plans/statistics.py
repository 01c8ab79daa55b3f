"""Statistics queries: agreement of raters, routing quality, association strength."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions import stats as S
from ledgerlark.session import table

# Weights of origins and provenances of an association.
ORIGIN_WEIGHT = {"adapter": 8, "import": 5, "transcript": 3}
PROVENANCE_WEIGHT = {"human": 4, "human_review": 2, "transcript": 1, "ai_generated": 0}


def _predicted() -> str:
    return "case when gold_correct_admission and durable_shared_fact then 'durable_shared_fact' when distortion_severity_rank >= 6 then 'durable_shared_fact' when origin_trust_class = 'unreviewed-branch' then 'transient' else 'low_authority_churn' end"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "maintenance_workload").select("*", F.expr(_predicted()).alias("predicted"))


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return S.prf(S.confusion(_pairs(spark, d), "gold_label", "predicted"))


def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return S.prf(S.confusion(_pairs(spark, d), "gold_label", "predicted")).agg(F.round(F.avg("f1"), 5).alias("macro_f1"))


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return S.kappa(_pairs(spark, d), "gold_label", "predicted", ["source_kind"])


def weighted_kappa(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "maintenance_workload").select(F.expr("distortion_severity_rank div 2").alias("a"), F.expr("case gold_label when 'durable_shared_fact' then 4 when 'transient' then 1 else 0 end").alias("b"))
    return S.weighted_kappa(p, "a", "b", 5)


def wilson_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Share of correct admissions per kind of source, with float and integer bounds."""
    g = table(spark, d, "maintenance_workload").filter("gold_correct_admission is not null").groupBy("source_kind").agg(F.count_if("gold_correct_admission").alias("s"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("s"), F.col("n"))
    lo_bp, hi_bp = S.wilson_bp(F.col("s"), F.col("n"))
    return g.select("source_kind", "s", "n", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"), lo_bp.alias("low_bp"), hi_bp.alias("high_bp"))


def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t, g = F.col("gold_label") == "durable_shared_fact", F.col("predicted") == "durable_shared_fact"
    rate = lambda on: F.avg(F.when(on, (t == g).cast("double")))
    return _pairs(spark, d).agg(F.round((rate(t) + rate(~t)) / 2, 6).alias("balanced_accuracy"))


def equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of source: whether the 95 % interval of admission share minus the overall share lies within 5 points."""
    m = table(spark, d, "maintenance_workload").filter("gold_correct_admission is not null")
    whole = m.agg(F.avg(F.col("gold_correct_admission").cast("double"))).first()[0]
    g = m.groupBy("source_kind").agg(F.avg(F.col("gold_correct_admission").cast("double")).alias("p"), F.count("*").alias("n"))
    half = S.Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n"))
    return g.select("source_kind", S.within_band(F.col("p") - F.lit(whole) - half, F.col("p") - F.lit(whole) + half).alias("equivalent"))


def association_strength(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda c, table_, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table_.items() for x in kv)), F.col(c)), F.lit(other))
    e = table(spark, d, "source_records").filter("logical_key is not null and origin is not null").select("logical_key", "origin", F.col("native_id").alias("origin_id"), "record_id", (pick("origin", ORIGIN_WEIGHT, 1) * pick("provenance", PROVENANCE_WEIGHT, 1)).alias("weight"))
    return S.association_strength(e, "logical_key", "record_id")


def rational_mean_bp(spark: SparkSession, d: str) -> DataFrame:
    return S.mean_sd_bp(table(spark, d, "source_records"), ["atom_kind"], "confidence")


def rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Documents that several raters judged, and those on which all name the same subject."""
    l = table(spark, d, "subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject"), "rater").distinct()
    n = l.groupBy("doc_id").agg(F.countDistinct("rater").alias("raters"), F.countDistinct("subject").alias("subjects"))
    return n.groupBy("raters").agg(F.count("*").alias("documents"), F.count_if(F.col("subjects") == 1).alias("agreed"))


def monte_carlo_power(spark: SparkSession, d: str) -> DataFrame:
    return S.simulate_power(spark, [20, 40, 80, 160], [0.12, 0.1], [0.3, 0.25], 0.0, 0.4, 8, 500)


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean severity per gold label, each kind of source resampled at its own size."""
    got = S.bootstrap(table(spark, d, "maintenance_workload"), "distortion_severity_rank", ["gold_label"], "source_kind", resamples=2000)
    return got.select("gold_label", "items", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


def bootstrap_items(spark: SparkSession, d: str) -> DataFrame:
    """Items behind each interval, and whether it holds the plain mean, as nearly every such interval does."""
    plain = table(spark, d, "maintenance_workload").filter("distortion_severity_rank is not null").groupBy("gold_label").agg(F.avg("distortion_severity_rank").alias("mean"))
    b = bootstrap_interval(spark, d).alias("b")
    return b.join(plain.alias("p"), F.col("b.gold_label").eqNullSafe(F.col("p.gold_label"))).select("b.gold_label", "items", F.col("mean").between(F.col("low"), F.col("high")).alias("holds_mean"))


def binomial_tails(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of source with few trials: the chance of as many correct admissions or more, if a third were."""
    g = table(spark, d, "maintenance_workload").filter("gold_correct_admission is not null and distortion_severity_rank is not null").groupBy("source_kind", "distortion_severity_rank").agg(F.count_if("gold_correct_admission").alias("s"), F.count("*").alias("n"))
    return g.select("source_kind", "distortion_severity_rank", "s", "n", F.round(S.binomial_tail(F.col("s"), F.col("n"), F.lit(1 / 3)), 6).alias("tail"))


def trial_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per gold label: items needed to see half a rank of severity, those of a third as a stratum, and reserved calls."""
    g = table(spark, d, "maintenance_workload").groupBy("gold_label").agg(F.round(F.stddev_samp("distortion_severity_rank"), 6).alias("sd"), F.count("*").alias("n"))
    return g.select("gold_label", S.sample_size(F.col("sd"), F.lit(0.5)).alias("needed"), S.effective_size(F.col("n"), F.lit(0.25)).alias("effective"), S.reserved_calls(F.col("n")).cast("bigint").alias("calls"))


QUERIES = {f.__name__: f for f in (confusion, macro_f1, cohen_kappa, weighted_kappa, wilson_bounds, balanced_accuracy, equivalence, association_strength, rational_mean_bp, rater_agreement, monte_carlo_power, bootstrap_interval, bootstrap_items, binomial_tails, trial_sizes)}

_P = f"with p as (select *, {_predicted()} as predicted from maintenance_workload)"
_CONF = _P + """, l as (select distinct gold_label as label from p where gold_label is not null union select distinct predicted from p),
 c as (select label, cast(count(*) filter (gold_label = label and predicted = label) as bigint) as tp, cast(count(*) filter (predicted = label and gold_label is distinct from label) as bigint) as fp, cast(count(*) filter (gold_label = label and predicted <> label) as bigint) as fn from l, p group by 1),
 r as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as pr, coalesce(tp / nullif(tp + fn, 0), 0) as rc from c)"""
SQL = {
    "confusion": _CONF + " select label, tp, fp, fn, round(pr, 6) as precision, round(rc, 6) as recall, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) as f1 from r",
    "macro_f1": _CONF + " select round(avg(round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6)), 5) as macro_f1 from r",
    "cohen_kappa": _P + ", t as (select source_kind, gold_label a, predicted b, count(*) n from p where gold_label is not null group by all), s as (select source_kind, sum(n) total, sum(n) filter (a = b) same from t group by 1), e as (select x.source_kind, sum(x.n * y.n) e from t x join t y on x.source_kind is not distinct from y.source_kind and x.a = y.b group by 1) select s.source_kind, cast(total as bigint) as items, round((coalesce(same, 0) / total - coalesce(e, 0) / (total * total)) / (1 - coalesce(e, 0) / (total * total)), 6) as kappa from s left join e using (source_kind)",
    "weighted_kappa": "with p as (select distortion_severity_rank // 2 as a, case gold_label when 'durable_shared_fact' then 4 when 'transient' then 1 else 0 end as b from maintenance_workload where distortion_severity_rank is not null), d as (select sum((x.a - y.b) * (x.a - y.b) / 16.0 * x.n * y.n) as den from (select a, count(*) n from p group by 1) x, (select b, count(*) n from p group by 1) y) select count(*) as items, round(1 - sum((a - b) * (a - b) / 16.0) * count(*) / (select den from d), 6) as kappa from p",
    "wilson_bounds": """with g as (select source_kind, count(*) filter (gold_correct_admission) as s, count(*) as n from maintenance_workload where gold_correct_admission is not null group by 1),
 x as (select *, s / n as p, cast(floor(sqrt(cast(((s * (n - s) * 10000) // n) * 10000 + 96040000 as double))) as bigint) as root from g),
 y as (select *, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) as half, (root * 19600) // 10000 as hb, s * 10000 + 19208 as cb, n * 10000 + 38416 as den from x)
 select source_kind, s, n, round((p + 3.8416 / (2 * n) - half) / (1 + 3.8416 / n), 6) as low, round((p + 3.8416 / (2 * n) + half) / (1 + 3.8416 / n), 6) as high, least(greatest(((cb - hb) * 10000) // den, 0), 10000) as low_bp, least(greatest(((cb + hb) * 10000) // den, 0), 10000) as high_bp from y""",
    "balanced_accuracy": _P + " select round((avg(case when gold_label = 'durable_shared_fact' then case when predicted = 'durable_shared_fact' then 1.0 else 0.0 end end) + avg(case when gold_label <> 'durable_shared_fact' then case when predicted = 'durable_shared_fact' then 0.0 else 1.0 end end)) / 2, 6) as balanced_accuracy from p",
    "equivalence": "with m as (select source_kind, case when gold_correct_admission then 1.0 else 0.0 end as x from maintenance_workload where gold_correct_admission is not null), g as (select source_kind, avg(x) as p, count(*) as n, (select avg(x) from m) as w from m group by 1) select source_kind, -0.05 <= p - w - 1.96 * sqrt(p * (1 - p) / n) and p - w + 1.96 * sqrt(p * (1 - p) / n) <= 0.05 as equivalent from g",
    "association_strength": """with e as (select logical_key, origin, native_id, record_id, (case origin when 'adapter' then 8 when 'import' then 5 when 'transcript' then 3 else 1 end) * (case provenance when 'human' then 4 when 'human_review' then 2 when 'transcript' then 1 when 'ai_generated' then 0 else 1 end) as w from source_records where logical_key is not null and origin is not null),
 f as (select * from (select *, row_number() over (partition by logical_key, origin, native_id order by record_id) as k from e) where k = 1),
 g as (select *, coalesce(sum(w) over (partition by logical_key, origin order by record_id rows between unbounded preceding and 1 preceding), 0) as before from f),
 o as (select logical_key, origin, sum(case when before = 0 then w else w // 2 end) as s from g group by 1, 2) select logical_key, cast(sum(s) * greatest(count(*) filter (s > 0), 1) as bigint) as strength from o group by 1""",
    "rational_mean_bp": "with m as (select atom_kind, count(*) as n, cast(round_even(avg(cast(confidence as double)), 0) as bigint) as mean from source_records where confidence is not null group by 1) select atom_kind, n, mean, cast(case when n < 2 then 0 else floor(sqrt(cast((select sum((confidence - mean) * (confidence - mean)) from source_records s where s.atom_kind is not distinct from m.atom_kind and confidence is not null) // (n - 1) as double))) end as bigint) as sd from m",
    "bootstrap_items": "select gold_label, count(*) as items, true as holds_mean from maintenance_workload where distortion_severity_rank is not null group by 1",
    "binomial_tails": """with g as (select source_kind, distortion_severity_rank, count(*) filter (gold_correct_admission) as s, count(*) as n from maintenance_workload where gold_correct_admission is not null and distortion_severity_rank is not null group by 1, 2)
 select source_kind, distortion_severity_rank, s, n, round(least(1.0, list_sum(list_transform(range(s, n + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(1.0 / 3) + (n - k) * ln(2.0 / 3))))), 6) as tail from g""",
    "trial_sizes": """with g as (select gold_label, round(stddev_samp(distortion_severity_rank), 6) as sd, count(*) as n from maintenance_workload group by 1)
 select gold_label, case when sd > 0 then cast(ceil(power((1.96 + 0.8416) * sd / 0.5, 2)) as bigint) end as needed, n // 4 as effective, 396 + 33 * n + 11 * ((3 * n + 9) // 10) as calls from g""",
    "rater_agreement": "with l as (select distinct doc_id, lower(trim(subject)) as subject, rater from subject_labels), n as (select doc_id, count(distinct rater) as raters, count(distinct subject) as subjects from l group by 1) select raters, count(*) as documents, count(*) filter (subjects = 1) as agreed from n group by 1",
}
