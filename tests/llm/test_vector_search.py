import numpy as np
import pytest
from cohortspark.llm.inner_products import op3_exact_top_k, top_inner_products
from cohortspark.llm.nearest import collision_counting, enough_collisions, nearest_neighbours, op4_nearest_neighbours
from pyspark.sql import functions as F


def vectors(seed, n=3000, dim=16):
    """Random vectors in clusters, with copies, awkward rows, rows of another dimension and large values."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] + rng.normal(size=dim) * 0.4).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(300)]  # one very common vector
    rows += [(5000 + 100 * i, v) for i, v in enumerate([None, [], [None] * dim, [float("nan")] * dim, [float("inf")] * dim, [0.0] * dim, [1e7] * dim])]
    rows += [(6000 + 100 * i, [float(i), -1.0]) for i in range(5)]
    rows += [(None, rows[1][1]), (7, rows[7][1])]
    return rows


def good(v, nonzero):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and (not nonzero or any(v))


def plain(rows, k, score, descending, nonzero):
    held = {(i, tuple(v)) for i, v in rows if i is not None and good(v, nonzero)}
    out = {}
    for i, v in held:
        if i % 100 == 0:
            found = [(score(v, w), j) for j, w in held if j != i and len(v) == len(w)]
            found.sort(key=lambda x: (-x[0] if descending else x[0], x[1]))
            out[i] = [(j, s) for s, j in found[:k]]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def whole(v):
    return [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 100)])
def test_inner_products_are_exact(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("y")).withColumn("score", F.lit(0))
    exact = {i: v for i, v in rows if i is not None}
    want = plain([(i, tuple(whole(v)) if good(v, False) else v) for i, v in rows], 10, lambda a, b: sum(x * y for x, y in zip(a, b)), True, False)
    assert collected(top_inner_products(df, block=block)) == {q: f for q, f in want.items() if f}
    assert exact


@pytest.mark.parametrize("seed, block", [(3, 16384), (4, 300)])
def test_neighbours_are_found(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("y"))

    def distance(a, b):
        return float(np.sqrt(((np.float32(b).astype(float) - np.float32(a).astype(float)) ** 2).sum()))

    want = {q: f for q, f in plain(rows, 10, distance, False, True).items() if f}
    got = collected(nearest_neighbours(df, block=block))
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert len(found) == len(want[q]) and found == sorted(found, key=lambda x: (x[1], x[0]))
        for j, s in found:
            assert s == pytest.approx(distance(dict(rows)[q], dict(rows)[j]), abs=1e-12)


@pytest.mark.parametrize("dim", [16, 64, 128])
def test_copies_are_found_in_later_blocks(dim):
    """With a bound of 0 from the first block, copies are found however their projections are rounded."""
    rng = np.random.default_rng(dim)
    x, kernel = rng.normal(size=(4096, dim)), collision_counting(10, 11)
    for size in (1, 1, 1, 1, 263, 509):
        at = rng.choice(len(x), size, replace=False)
        found = kernel(10_000 + at, x[at], np.arange(len(x)), x, np.zeros(size))
        assert [(ids.tolist(), scores.tolist()) for ids, scores in found] == [([i], [0.0]) for i in at]


def test_collisions_needed():
    assert enough_collisions(10, 1.0, 0.9) == 10
    assert 0 < enough_collisions(48, 0.8, 0.99) < enough_collisions(48, 0.8, 0.5) < 48


def test_queries_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>")
    df.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert [r.vec_id for r in op3_exact_top_k(spark, f"{tmp_path}/a").orderBy("rank").collect()] == [1, 2, 3]
    assert [r.vec_id for r in op4_nearest_neighbours(spark, f"{tmp_path}/a").orderBy("rank").collect()] == [1, 2, 3]
    for op in (op3_exact_top_k, op4_nearest_neighbours):
        assert op(spark, f"{tmp_path}/b").count() == 0
