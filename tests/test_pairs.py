import random
from itertools import combinations

import pytest

from tidelens.functions import distributed as d
from tidelens.operators import affinity

#: Items 0-9 are frequent and together; hundreds of others come in many baskets, each pair of them once or twice.
FREQUENT, RARE = 10, 300


@pytest.fixture(scope="module")
def baskets():
    rng = random.Random(5)
    rows = []
    for k in range(400):
        items = {f"f{i}" for i in range(FREQUENT) if rng.random() < 0.8}
        rows += [(k % 3, k, x) for x in items]
    for k in range(400, 700):
        rows += [(k % 3, k, f"r{i}") for i in rng.sample(range(RARE), 6)]
    return rows


def brute(rows, n, by=False):
    counts = {}
    per = {}
    for m, k, x in set(rows):
        per.setdefault((m, k), set()).add(x)
    for (m, _), items in per.items():
        for p in combinations(sorted(items), 2):
            key = (m if by else 0, *p)
            counts[key] = counts.get(key, 0) + 1
    out = []
    for g in sorted({k[0] for k in counts}):
        out += sorted(((*k, c) for k, c in counts.items() if k[0] == g), key=lambda r: (-r[3], r[1], r[2]))[:n]
    return sorted(out), counts


def frame(spark, rows):
    return spark.createDataFrame(rows, "merchant int, basket int, item string")


def top(spark, rows, n, **more):
    got = d.top_pairs(frame(spark, rows), ["merchant", "basket"], "item", n, **more).collect()
    return sorted((r["merchant"] if "by" in more else 0, r["a"], r["b"], r["count"]) for r in got)


@pytest.mark.parametrize("n", [1, 7, 45, 60])
def test_top_pairs_equal_all_pairs(spark, baskets, n):
    assert top(spark, baskets, n, first=8) == brute(baskets, n)[0]
    assert top(spark, baskets, n, first=4, by=["merchant"]) == brute(baskets, n, by=True)[0]


def test_more_pairs_wanted_than_there_are(spark):
    rows = [(0, 1, "a"), (0, 1, "b"), (0, 1, "b"), (0, 2, "c"), (0, 3, None), (0, 3, "a")]
    assert top(spark, rows, 9, first=1) == [(0, "a", "b", 1)]
    assert top(spark, [], 9) == []


def test_no_pair_below_the_bound_is_formed(spark, baskets, monkeypatch):
    """Counts of the pairs formed: none has a member rarer than the n-th pair, though most pairs of the baskets do."""
    n = 20
    formed = []
    plain = d.item_pairs

    def watched(rows, keys, item, *a, **k):
        pairs = plain(rows, keys, item, *a, **k)
        formed.append({tuple(r) for r in pairs.select("a", "b").distinct().collect()})
        return pairs

    monkeypatch.setattr(d, "item_pairs", watched)
    assert top(spark, baskets, n, first=FREQUENT) == brute(baskets, n)[0]
    counts = brute(baskets, n)[1]
    nth = brute(baskets, n)[0]
    least = min(r[3] for r in nth)
    frequency = {}
    for _, k, x in set(baskets):
        frequency[x] = frequency.get(x, 0) + 1
    pairs = set().union(*formed)
    assert pairs and all(min(frequency[a], frequency[b]) >= least for a, b in pairs)
    below = {k for k in counts if min(frequency[k[1]], frequency[k[2]]) < least}
    assert len(below) > 10 * len(pairs)


def test_affinity_reports_use_bounds(spark, baskets):
    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    orders = spark.createDataFrame([(m, day + dt.timedelta(days=k), x) for m, k, x in baskets], "user_id int, event_time timestamp, merchant string")
    got = [(r["merchant_1"], r["merchant_2"], r["co_occurrence"]) for r in affinity.merchant_affinity(orders, n=5).collect()]
    everything = {(r["merchant_1"], r["merchant_2"], r["co_occurrence"]) for r in affinity.merchant_affinity(orders).collect()}
    assert set(got) <= everything and sorted(r[2] for r in got) == sorted((r[2] for r in everything), reverse=True)[:5][::-1]


def test_tasks_follow_rows_and_pairs(spark):
    """Packing and forming pairs is dealt by what there is to do, not by a fixed number of partitions."""
    rows = spark.createDataFrame([(k, f"i{x}") for k in range(60) for x in range(5)], "k int, item string")
    few, many = (d.item_pairs(rows, ["k"], "item", **more) for more in ({}, {"most": 30}))
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 10
    assert sorted(few.collect()) == sorted(many.collect()) and few.count() == 600
    assert d.item_pairs(rows, ["k"], "item", task=20).rdd.getNumPartitions() == 38
    assert sorted(d.distinct_rows(rows.union(rows), ["k", "item"], most=100).collect()) == sorted(rows.collect())


def test_pair_counts_form_no_pairs_in_a_shuffle(spark):
    """Counts come from packed lists; keys may be null, several, and part of ``by``."""
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 1, "b"), (2, 1, "a"), (2, 1, "b"), (1, 2, "b"), (1, 2, "a"), (None, 1, "a"), (None, 1, "b"), (1, 1, None)], "m int, k int, item string")
    assert [tuple(r) for r in d.pair_counts(rows, ["m", "k"], "item").collect()] == [("a", "b", 3)]
    assert sorted(tuple(r) for r in d.pair_counts(rows, ["m", "k"], "item", by=["m"]).collect()) == [(1, "a", "b", 2), (2, "a", "b", 1)]
    plan = d.pair_counts(rows, ["m", "k"], "item")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "SortMergeJoin [k" not in plan
