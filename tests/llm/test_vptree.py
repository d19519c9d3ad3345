import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm.queries import QUERIES
from tidelens.llm.shared import table
from tidelens.llm.vptree import nearest_neighbours


def brute(rows, asks, k):
    out = []
    for q, v in rows:
        if asks(q):
            found = sorted((-float(np.dot(np.float64(v), np.float64(w))), i) for i, w in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return out


def test_recall_of_the_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want = {(q, i) for q, _, i, _ in brute(rows, lambda q: q % 20 == 0, 20)}
    got = QUERIES["op1_vantage_point_trees"](spark, sf).collect()
    assert len(got) == len(want)
    assert len({(r["query_id"], r["vec_id"]) for r in got} & want) >= 0.95 * len(want)


def test_exact_with_slack_one_over_shards_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=5).astype(np.float32)]) for i in range(300)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(40)]
    odd = [(2000, None), (2001, [0.0] * 5), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 5), (2004, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (2005, [1.0])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, shard int, v string")
    got = nearest_neighbours(df, F.col("vec_id") % 7 == 0, k=6, slack=1.0, shard_rows=64).orderBy("query_id", "rank").collect()
    want = brute(vectors, lambda q: q % 7 == 0, 6)
    assert [(r[0], r[1], r[2]) for r in got] == [w[:3] for w in want]
    assert np.allclose([r[3] for r in got], [w[3] for w in want], rtol=1e-12)


def test_many_different_vectors_at_one_distance(spark):
    """2000 different vectors tie; the smallest ids win, in every shard and over all."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, *(float(np.float32(x)) for x in rng.normal(size=3))]) for i in rng.permutation(2000).tolist()]
    rows += [(5000, [1.0, 0.0, 0.0, 0.0]), (5001, [-1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard_rows in (300, 16384):
        got = nearest_neighbours(df, F.col("vec_id") == 5000, k=20, slack=1.0, shard_rows=shard_rows).orderBy("rank").collect()
        assert [r["vec_id"] for r in got] == list(range(20)) and {r["score"] for r in got} == {1.0}
    got = nearest_neighbours(df, F.col("vec_id") == 5000, k=20, slack=0.3, shard_rows=300).collect()
    assert len(got) == 20 and {r["score"] for r in got} == {1.0}


@pytest.mark.parametrize("n", [0, 1, 3])
def test_small_tables(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    assert nearest_neighbours(df, k=20).count() == n * max(0, n - 1)
