"""Roll-ups: position counts, ratios, headlines, dimensions and the status-only baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("pass", "fail", "unknown", "na")


def count_positions(positions: DataFrame, *by: str) -> DataFrame:
    """Counts of each state by group; they add up to n_positions."""
    n = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATES]
    return positions.groupBy(*by).agg(F.count(F.lit(1)).alias("n_positions"), *n)


def sampled_ratio(verified: Column, unknown: Column, extracted: Column, excluded: Column) -> Column:
    d = extracted - excluded
    return F.when(d <= 0, 1.0).otherwise(F.least(F.lit(1.0), (verified + unknown) / d))


def headline(n_pass: Column, n_fail: Column, n_unknown: Column) -> Column:
    """Half or more unknown makes a report untrusted; then failures, with and without unknown ones, then the rest."""
    n = n_pass + n_fail + n_unknown
    return (
        F.when((n > 0) & (2 * n_unknown >= n), "untrusted")
        .when((n_fail > 0) & (n_unknown > 0), "failures_and_unknown")
        .when(n_fail > 0, "failures")
        .when(n_unknown > 0, "unknown")
        .otherwise("clean")
    )


def dimension_colour(n_fail: Column, n_warn: Column, n_unknown: Column) -> Column:
    return F.when(n_fail > 0, "red").when(n_warn > 0, "yellow").when(n_unknown > 0, "gray").otherwise("green")


def exit_code(interrupted: Column, untrusted: Column, reached: Column) -> Column:
    return F.when(interrupted, 130).when(untrusted, 2).when(reached, 1).otherwise(0)


def with_skeleton(skeleton: DataFrame, results: DataFrame) -> DataFrame:
    """Every position of the skeleton; one without a result is unknown, never pass."""
    r = results.select("position_id", "status", "reason")
    return skeleton.join(r, "position_id", "left").withColumn("status", F.coalesce("status", F.lit("unknown"))).withColumn("reason", F.coalesce("reason", F.lit("not_evaluated")))


def confusion(predictions: DataFrame, *by: str) -> DataFrame:
    """Of rows with truth and predicted: the four counts, the rate of false positives among predicted, and recall."""
    t, p = F.col("truth"), F.col("predicted")
    agg = predictions.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    return agg.select("*", F.try_divide(F.col("fp"), F.col("tp") + F.col("fp")).alias("fp_rate"), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))
