import numpy as np
from pyspark.sql import functions as F

from pagelens.llm.vectors import Tile, link_vectors, tile_links, unit_vectors


def brute(rows, threshold):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a].add(b)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    rows = [(i, [float(np.float32(x)) for x in centers[i % 30] + rng.normal(size=16) * (0.1 + 0.02 * (i % 20))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, [2 * x for x in rows[3][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None, *rows[0][1][1:]]), (3004, [float("nan"), *rows[0][1][1:]]), (3005, [float("inf")] * 16), (3006, rows[0][1][:8]), (3007, rows[0][1][:8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit(1)).withColumn("x", F.lit("clash"))
    rows = [(r["vec_id"], r["embedding"]) for r in df.select("vec_id", "embedding").collect()]
    for block in (64, 4096):
        got = {r[0]: tuple(r)[1:] for r in link_vectors(df, threshold=0.9, block=block).collect()}
        assert got == brute(rows, 0.9)


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(2)
    for dim in (2, 3, 64, 300):
        x = rng.normal(size=(300, dim)) * np.exp(rng.normal(size=(300, dim)) * 2)
        x[150:] = x[:150] + rng.normal(size=(150, dim)) * np.abs(x[:150]) * 0.4
        u = unit_vectors(x)
        i, j = tile_links(Tile(np.arange(150), np.ones(150, int), u[:150]), Tile(np.arange(150), np.ones(150, int), u[150:]), 0.9)
        exact = np.einsum("id,jd->ij", u[:150], u[150:])
        sure = set(zip(*np.nonzero(exact >= 0.9 + 1e-12), strict=True))
        got = set(zip(i.tolist(), j.tolist(), strict=True))
        assert {(int(a), int(b)) for a, b in sure} <= got and all(exact[p] >= 0.9 - 1e-12 for p in got)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r[0] or -1), r["n_links"], r["component_id"], r["kept"]) for r in link_vectors(df).collect())
    assert got == [(-1, 0, None, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert link_vectors(df.limit(0)).count() == 0
