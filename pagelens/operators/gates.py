"""Gates over labelled dead-link candidates: score, thresholds, composition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidates, dead ones and recorded ones that the labels must hold, highest rate of false positives, composition by label and rule, provenances.
CANDIDATES, TRULY_DEAD, LEAST_RECORDED, MOST_FP_RATE = 42, 25, 12, 0.05
PROVENANCES = ("recorded", "recovered_live", "reconstructed", "spec_only")


def score_labels(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: candidates, truly dead, predicted dead, false positives and negatives, wrong rules, rates. labels (id, label, expect_rule, provenance), verdicts (id, state, final_rule). A candidate without a verdict is not predicted dead."""
    j = labels.filter("label in ('dead', 'false_positive')").join(verdicts, "id", "left")
    truth, said = F.col("label") == "dead", F.coalesce(F.col("state") == "dead", F.lit(False))
    wrong = ~truth & ~said & F.col("expect_rule").isNotNull() & (F.coalesce("final_rule", F.lit("")) != F.col("expect_rule"))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("id"))))
    g = j.agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(truth).alias("n_true_dead"), F.count_if(said).alias("n_pred_dead"), ids(~truth & said).alias("fp"), ids(truth & ~said).alias("fn"), ids(wrong).alias("wrong_rule"), F.count_if(F.col("provenance") == "recorded").alias("n_recorded"))
    return g.select("*", F.coalesce(F.try_divide(F.size("fp"), F.col("n_pred_dead")), F.lit(0.0)).alias("fp_rate"), F.coalesce(F.try_divide(F.col("n_true_dead") - F.size("fn"), F.col("n_true_dead")), F.lit(1.0)).alias("recall"))


def gate_results(scores: DataFrame) -> DataFrame:
    """The six gates of a score: (gate, passed, value)."""
    gate = lambda name, ok, value: F.struct(F.lit(name).alias("gate"), F.coalesce(ok, F.lit(False)).alias("passed"), value.cast("double").alias("value"))
    rows = F.array(
        gate("candidates", F.col("n_candidates") >= CANDIDATES, F.col("n_candidates")), gate("truly_dead", F.col("n_true_dead") >= TRULY_DEAD, F.col("n_true_dead")), gate("recorded", F.col("n_recorded") >= LEAST_RECORDED, F.col("n_recorded")),
        gate("fp_rate", F.col("fp_rate") < MOST_FP_RATE, F.col("fp_rate")), gate("recall", F.size("fn") == 0, F.col("recall")), gate("rules", F.size("wrong_rule") == 0, F.size("wrong_rule")),
    )
    return scores.select(F.explode(rows).alias("g")).select("g.*")


def unused_rules(labels: DataFrame, verdicts: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """Rules that no candidate meets."""
    every = labels.sparkSession.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(verdicts.select(F.col("final_rule").alias("rule")).distinct(), "rule", "left_anti")


def label_problems(labels: DataFrame) -> DataFrame:
    """Labels that are not well-formed: (id, problem). Repeated ids, unknown provenance, no label, a false positive without the rule that should catch it."""
    twice = labels.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    found = F.array(F.when(~F.coalesce(F.col("provenance").isin(*PROVENANCES), F.lit(False)), "provenance"), F.when(F.coalesce("label", F.lit("")) == "", "label"), F.when((F.col("label") == "false_positive") & F.col("expect_rule").isNull(), "expect_rule"), F.when(F.coalesce("url", F.lit("")) == "", "url"))
    return labels.select("id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem")).union(twice)


def composition(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label", F.coalesce("expect_rule", F.lit("")).alias("expect_rule")).agg(F.count(F.lit(1)).alias("n"))
