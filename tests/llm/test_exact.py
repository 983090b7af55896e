import hashlib

from pyspark.sql import functions as F

from pagelens.llm.exact_dedup import exact_dedup, normalised_exact_dedup


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    return {i: (keep(groups[lower(t)]), len(groups[lower(t)]), i == keep(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows}


ROWS = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 5000), (8, "X" * 5000), (9, "K"), (10, "k"), (11, "İ"), (12, "only")]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("_h", F.lit(0))
    for keep, f in (("min", min), ("max", max)):
        got = {r[0]: tuple(r)[1:] for r in normalised_exact_dedup(df, keep=keep).collect()}
        assert got == brute(ROWS, f)


def test_collisions_are_told_apart(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup(df, content_hash=F.length).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def test_hot_group_empty_and_repeated(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup(df)
    assert got.filter("group_size = 1000").count() == 1000 and got.filter("kept").count() == 2001
    assert exact_dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "doc_id long, text string")
    assert sorted(r["kept"] for r in exact_dedup(twice).collect()) == [False, True, True]
