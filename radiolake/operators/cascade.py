"""The weighted decision on each candidate pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.operators.candidates import profile_of

IDENTITY = "irk_resolution"


def gather(scores: dict[str, DataFrame]) -> DataFrame:
    """Scores of all signals as rows ``a, b, signal, score``, those that say something; each signal scores a pair once."""
    return reduce(DataFrame.unionByName, [df.select("a", "b", F.lit(name).alias("signal"), F.col("score").cast("double").alias("score")).filter("score is not null") for name, df in scores.items()])


def decide(pairs: DataFrame, gathered: DataFrame, rules: DataFrame, profiles: dict[str, dict]) -> DataFrame:
    """``a, b, device_class, profile, outcome, score, reason, contributions`` of every pair.

    Outcomes, in this order: an identity key settles a pair either way; a signal required for merging that is silent rejects; a decisive
    signal over its threshold merges unless some signal is under the negative bound; a signal required eventually that is silent
    abstains, as does too little weight; else the weighted mean against the threshold merges or rejects. Signals count in the order of the
    profile's weights; scores are clamped to [-1, 1]; a weight of 0 still takes part in the bound. Only signals with a weight can be required.

    Pairs meet their scores in one join, whose partitioning by pair the aggregation takes over; the rules (a few dozen rows) are broadcast to it, and
    what is silent comes out of a mask of the signals that spoke.
    """
    weighed = F.broadcast(rules.select("profile", "signal", "ord", "weight", "decisive", "decisive_threshold"))
    joined = pairs.select("a", "b", "device_class").join(gathered, ["a", "b"], "left").withColumn("profile", profile_of(F.col("device_class"), profiles)).join(weighed, ["profile", "signal"], "left")
    s, w = F.when(F.col("weight").isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "score"))), F.col("weight")
    heard = joined.withColumn("s", s).groupBy("a", "b", "device_class", "profile").agg(
        F.min("s").alias("worst"), F.max(F.when(F.col("decisive") & (F.col("s") >= F.col("decisive_threshold")), F.col("s"))).alias("best"),
        F.coalesce(F.sum("weight"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.col("s") * w), F.lit(0.0)).alias("weighted"),
        F.coalesce(F.bit_or(F.expr("shiftleft(1, ord)")), F.lit(0)).alias("spoke"), F.max(F.when(F.col("signal") == IDENTITY, F.col("score"))).alias("irk"),
        F.array_sort(F.collect_list(F.when(w.isNotNull(), F.struct("ord", "signal", F.col("s").alias("score"), "weight")))).alias("items"),
    )
    bits = lambda keep: F.sum(F.when(keep, F.expr("shiftleft(1, ord)")).otherwise(0)).cast("int")
    required = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.struct("ord", "signal"))))
    per = rules.groupBy("profile").agg(
        *[F.first(c).alias(c) for c in ("threshold", "min_total_weight", "negative_block")], bits(F.col("for_merge")).alias("for_merge"), required(F.col("for_merge")).alias("merge_names"),
        bits(F.col("eventually") & ~F.col("for_merge")).alias("eventually"), required(F.col("eventually") & ~F.col("for_merge")).alias("eventual_names"),
    )
    known = heard.join(F.broadcast(per), "profile")  # a row per profile
    silent = F.bitwise_not("spoke")

    def lacking(names: str) -> Column:
        return F.array_join(F.transform(F.filter(names, lambda r: F.expr("spoke").bitwiseAND(F.pow(F.lit(2), r["ord"]).cast("int")) == 0), lambda r: r["signal"]), ",")

    case = (
        F.when(F.col("irk") >= 0.999, 1).when(F.col("irk") <= -0.999, 2).when(F.col("for_merge").bitwiseAND(silent) != 0, 3).when((F.col("worst") >= F.col("negative_block")) & F.col("best").isNotNull(), 4)
        .when(F.col("eventually").bitwiseAND(silent) != 0, 5).when(F.col("total") < F.col("min_total_weight") - 1e-12, 6).otherwise(0)
    )
    known, case, mean = known.withColumn("case", case), F.col("case"), F.coalesce(F.try_divide("weighted", "total"), F.lit(0.0))
    outcome = F.when(case.isin(1, 4), "merge").when(case.isin(2, 3), "reject").when(case.isin(5, 6), "abstain").when(mean >= F.col("threshold"), "merge").otherwise("reject")
    value = F.when(case == 1, 1.0).when(case == 2, -1.0).when(case == 3, 0.0).when(case == 4, F.col("best")).when(case == 0, mean)
    reason = (
        F.when(case == 2, "irk_mismatch").when(case == 3, F.concat(F.lit("missing_required_for_merge:"), lacking("merge_names"))).when(case == 5, F.concat(F.lit("missing_eventually:"), lacking("eventual_names")))
        .when(case == 6, F.format_string("below_min_total_weight:%.2f/%.2f", F.col("total"), F.col("min_total_weight")))
    )
    contributions = F.transform("items", lambda i: F.struct(i["signal"].alias("signal"), i["score"].alias("score"), i["weight"].alias("weight")))
    return known.select("a", "b", "device_class", "profile", outcome.alias("outcome"), value.alias("score"), reason.alias("reason"), contributions.alias("contributions"))


def counters(decided: DataFrame) -> DataFrame:
    """Pairs, merges, rejections and abstentions by class and reason."""
    return decided.groupBy("device_class", "outcome", F.substring_index("reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def as_json(decided: DataFrame) -> DataFrame:
    """One JSON line per decision, for a text sink."""
    return decided.select(F.to_json(F.struct("a", "b", "profile", "outcome", "score", "reason", "contributions")).alias("value"))
