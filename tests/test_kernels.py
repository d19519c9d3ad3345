import itertools
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelens.functions import columns as c
from tidelens.functions import distributed as d


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(7)
    values = [round(rng.uniform(-50, 50), 1) for _ in range(300)] + [3.0] * 150 + [0.0] * 20
    return values, spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(values)], "id long, v double, g int")


def test_positions_match_sorted_order(numbers):
    values, df = numbers
    got = {r["v"]: (r["before"], r["cnt"], r["total"]) for r in d.value_positions(df, "v").collect()}
    s = sorted(values)
    for v, (before, cnt, total) in got.items():
        assert before == sum(x < v for x in s) and cnt == s.count(v) and total == len(s)


def test_quantiles_match_linear_interpolation(numbers):
    values, df = numbers
    points = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    row = d.quantiles(df, "v", points).first()
    for name, q in points.items():
        assert row[name] == pytest.approx(np.quantile(values, q))
    pdf = df.toPandas()
    for r in d.quantiles(df, "v", {"m": 0.5, "p": 0.75}, ["g"]).collect():
        x = pdf[pdf.g == r["g"]].v
        assert r["m"] == pytest.approx(x.median()) and r["p"] == pytest.approx(x.quantile(0.75))


def test_quantiles_of_empty_and_null(spark):
    e = spark.createDataFrame([(None,), (None,)], "v double")
    assert d.quantiles(e, "v", {"m": 0.5}).first()["m"] is None


def test_percentile_rank_averages_ties(numbers):
    _, df = numbers
    pdf = d.percentile_ranks(df, {"v": "r"}).toPandas().sort_values("id")
    assert np.allclose(pdf.r, pdf.v.rank(pct=True))


def test_ordinal_bins_match_equal_count_cut(numbers):
    _, df = numbers
    for n in (4, 5):
        cuts = d.scalar_row(d.ordinal_cuts(df, "v", "id", n))
        pdf = df.withColumn("_c", cuts).withColumn("b", d.ordinal_bin(F.col("_c"), "v", "id", n)).toPandas().sort_values(["v", "id"])
        want = pd.qcut(pd.Series(range(1, len(pdf) + 1)), n, labels=range(1, n + 1)).astype(int)
        assert list(pdf.b) == list(want)


def test_round_half_even_and_bins(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.5,), (-0.25,)], "v double")
    assert [r[0] for r in df.select(c.round_half_even(F.col("v"), 1)).collect()] == [0.2, 0.4, 2.5, -0.2]
    b = spark.createDataFrame([(0.0,), (1.0,), (1.1,), (9.0,)], "v double").select(c.bins(F.col("v"), (0, 1, 5, c.INF), ("a", "b", "c")))
    assert [r[0] for r in b.collect()] == [None, "a", "b", "c"]


def test_whole_days_floor_also_below_zero(spark):
    df = spark.createDataFrame([(-1,), (0,), (86_400_000_000 - 1,), (86_400_000_000,)], "u long")
    assert [r[0] for r in df.select(c.whole_days(F.col("u"))).collect()] == [-1, 0, 0, 1]


def test_json_helpers(spark):
    df = spark.createDataFrame([('{"a": "", "b": "x"}',), ('{"a": 0, "b": 5}',), ("not json",), (None,)], "p string")
    got = df.select(c.json_text(F.col("p"), "a", "b"), c.json_number(F.col("p"), "a", "b")).collect()
    assert [r[0] for r in got] == ["x", "0", None, None]
    assert [r[1] for r in got] == [None, 5.0, None, None]


@pytest.mark.parametrize("block", [512, 3])
def test_pairs_once_each_whatever_the_block(spark, block):
    rng = random.Random(3)
    baskets = {k: sorted(rng.sample(range(40), rng.choice([1, 2, 5, 23]))) for k in range(12)}
    rows = spark.createDataFrame([(k, f"i{x:02}") for k, xs in baskets.items() for x in xs], "k int, item string")
    got = sorted((r["k"], r["a"], r["b"]) for r in d.item_pairs(rows, ["k"], "item", block=block).collect())
    want = sorted((k, f"i{a:02}", f"i{b:02}") for k, xs in baskets.items() for a, b in itertools.combinations(xs, 2))
    assert got == want


def test_pair_counts_prune_without_changing_the_result(spark):
    rows = spark.createDataFrame([(k, i) for k in range(30) for i in ("x", "y", f"r{k}")] + [(1, "x")], "k int, item string")
    got = [tuple(r) for r in d.pair_counts(rows, ["k"], "item", 2).collect()]
    assert got == [("x", "y", 30)]


def test_transitions_across_chunks(spark, make_events):
    rng = random.Random(11)
    rows = [(u, m, rng.choice("abc")) for u in range(5) for m in sorted(rng.sample(range(0, 3000), 60))]
    got = {(r["event_type"], r["next_event"]): r["count"] for r in d.transition_counts(make_events(rows)).collect()}
    want = {}
    for u in range(5):
        seq = [k for uu, _, k in rows if uu == u]
        for a, b in zip(seq, seq[1:]):
            want[a, b] = want.get((a, b), 0) + 1
    assert got == want


def test_percentile_ranks_of_small_and_mixed_values(spark):
    rows = [(1, 1e-10, 5), (2, 2e-10, 5), (3, None, 7), (4, 0.1 + 0.2, 1), (5, 0.3, None), (6, -4e12, 9)]
    df = spark.createDataFrame(rows, "id int, x double, n long")
    got = {r["id"]: (r["px"], r["pn"]) for r in d.percentile_ranks(df, {"x": "px", "n": "pn"}).collect()}
    assert got == {1: (0.4, 0.5), 2: (0.6, 0.5), 3: (None, 0.8), 4: (0.9, 0.2), 5: (0.9, None), 6: (0.2, 1.0)}
