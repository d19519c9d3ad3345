import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelens.functions import distributed
from tidelens.functions.distributed import ordinal_ranks, pair_sums
from tidelens.operators import recommender as r


@pytest.fixture(scope="module")
def counts():
    """(user, merchant) -> count: a few users order everywhere, merchants of one family share their customers."""
    rng = random.Random(4)
    out = {}
    for u in range(3):
        for m in range(40):
            out[u, f"m{m:02}"] = rng.randrange(1, 4)
    for u in range(3, 200):
        family = rng.randrange(8)
        for k in range(5):
            if rng.random() < 0.85:
                out[u, f"m{family * 5 + k:02}"] = rng.randrange(1, 6)
        out[u, f"m{rng.randrange(40):02}"] = 1
    return out


@pytest.fixture(scope="module")
def inter(spark, counts):
    return spark.createDataFrame([(u, m, c) for (u, m), c in counts.items()], "user_id long, merchant string, cnt long")


def cosines(counts):
    by = {}
    for (u, m), c in counts.items():
        by.setdefault(m, {})[u] = c
    norm = {m: math.sqrt(sum(c * c for c in v.values())) for m, v in by.items()}
    out = {}
    for a in by:
        for b in by:
            dot = sum(c * by[b].get(u, 0) for u, c in by[a].items())
            if a != b and dot:
                out[a, b] = dot / (norm[a] * norm[b])
    return out


def pairs(df):
    return {(x["merchant"], x["other"]): x["similarity"] for x in df.collect()}


def test_whole_similarity(inter, counts):
    assert pairs(r.item_similarity(inter)) == pytest.approx(cosines(counts))


@pytest.mark.parametrize("least", [0.2, 0.5, 0.8, 0.99])
def test_bounds_lose_no_pair(inter, counts, least):
    want = {k: v for k, v in cosines(counts).items() if round(v, 9) >= least}
    assert pairs(r.item_similarity(inter, min_similarity=least)) == pytest.approx(want)


def test_bounds_form_few_pairs(inter, counts):
    """The users who order everywhere are left out of the index, and with them most pairs."""
    part = r.indexed_part(inter, 0.6).collect()
    users = {x["user_id"] for x in part}
    assert not users & {0, 1, 2} and len(part) < len(counts)

    def formed(rows):
        per = {}
        for u, m in rows:
            per.setdefault(u, set()).add(m)
        return sum(len(x) * (len(x) - 1) // 2 for x in per.values())

    assert formed([(x["user_id"], x["merchant"]) for x in part]) < 0.6 * formed(counts)
    for x in part:
        assert x["bound"] < 0.6


def test_nothing_to_compare(spark, inter):
    empty = inter.limit(0)
    assert r.item_similarity(empty).count() == 0 and r.item_similarity(empty, min_similarity=0.3).count() == 0
    one = spark.createDataFrame([(1, "a", 2)], inter.schema)
    assert r.item_similarity(one, min_similarity=0.3).count() == 0


def test_saved_and_loaded(spark, inter, counts, tmp_path):
    fitted = r.ItemItemRecommender.fit(inter)
    fitted.save(str(tmp_path / "model"))
    loaded = r.ItemItemRecommender.load(spark, str(tmp_path / "model"))
    assert pairs(loaded.similarity) == pytest.approx(cosines(counts))
    key = ["user_id", "merchant", "rank"]
    assert sorted(loaded.recommend(3).select(key).collect()) == sorted(r.recommend(inter, r.item_similarity(inter), 3).select(key).collect())
    assert loaded.stats().first() == r.stats(inter).first()


def test_popular_lists(inter, counts):
    totals = {}
    for (_, m), c in counts.items():
        totals[m] = totals.get(m, 0) + c
    order = sorted(totals, key=lambda m: (-totals[m], m))
    got = {}
    for x in r.recommend_popular(inter, 4).collect():
        got.setdefault(x["user_id"], {})[x["rank"]] = x["merchant"]
    for u in {u for u, _ in counts}:
        want = [m for m in order if (u, m) not in counts][:4]
        assert [got.get(u, {})[k] for k in sorted(got.get(u, {}))] == want


def test_ranks_without_a_window_over_everything(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("v"))
    ranked = ordinal_ranks(df, [F.desc("v"), F.asc("id")], "place")
    got = [x["id"] for x in sorted(ranked.collect(), key=lambda x: x["place"])]
    assert got == [x["id"] for x in sorted(df.collect(), key=lambda x: (-x["v"], x["id"]))]
    assert {x["place"] for x in ranked.collect()} == set(range(1, 5001))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan.split("Subquery")[0]


def listed(df):
    return sorted((x["user_id"], x["rank"], x["merchant"], round(x["score"], 8)) for x in df.collect())


@pytest.mark.parametrize("block", [2_000_000, 90])
@pytest.mark.parametrize("ordered", [True, False])
def test_lists_from_blocks_equal_all_scores(inter, block, ordered):
    """Blocks of similarities, however small, give the lists of all scores."""
    sim = r.item_similarity(inter)
    scores = r.score_all(inter, sim).where("score > 0")
    if ordered:
        scores = scores.join(inter, ["user_id", "merchant"], "left_anti")
    want = r.top_per_group(scores, ["user_id"], [F.desc(F.round("score", 9)), F.asc("merchant")], 7)
    assert listed(r.recommend(inter, sim, 7, ordered, block=block)) == listed(want)


def test_lists_of_odd_histories(spark):
    """Users without id, merchants without neighbour or name; ties go by name; the whole history divides."""
    inter = spark.createDataFrame([(1, "a", 1), (1, "lone", 4), (1, None, 2), (None, "a", 1), (2, "lone", 1)], "user_id long, merchant string, cnt long")
    sim = spark.createDataFrame([("a", x, 0.5) for x in ("d", "b", "c")], "merchant string, other string, similarity double")
    assert listed(r.recommend(inter, sim, 2)) == [(1, k, m, round(0.5 * math.log(2) / 3, 8)) for k, m in ((1, "b"), (2, "c"))]
    assert r.recommend(inter, sim.limit(0), 2).count() == 0


def test_lists_shuffle_no_scores(inter):
    """Scores are summed where they are formed: no aggregate by user and recommended merchant follows."""
    plan = r.recommend(inter, r.item_similarity(inter), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "log1p" not in plan.lower()


@pytest.mark.parametrize("block, hot", [(512, 32_768), (4, 32_768), (7, 3)])
def test_pair_sums_equal_all_pairs(spark, counts, block, hot):
    want = {}
    rows = {}
    for (u, m), c in counts.items():
        rows.setdefault(u, []).append((m, c))
    for items in rows.values():
        for a, x in items:
            for b, y in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + x * y
    df = spark.createDataFrame([(u, m, c) for (u, m), c in counts.items()] + [(None, "m01", 3), (7, None, 1)], "user_id long, merchant string, cnt long")
    got = pair_sums(df, "user_id", "merchant", "cnt", block=block, task=50, hot=hot)
    assert {(x["a"], x["b"]): x["total"] for x in got.collect()} == want


def test_pairs_do_not_travel(inter):
    """The sums by pair follow from the dealing by owner: one exchange of packed lists, none of pairs."""
    plan = pair_sums(inter, "user_id", "merchant", "cnt", task=50)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(_a#\d+, \d+\), REPARTITION_BY_NUM", plan)
    assert not re.search(r"hashpartitioning\([^)]*_b#\d+, \d+\), ENSURE_REQUIREMENTS[^*]*HashAggregate", plan) and plan.count("HashAggregate") == 2


def test_a_block_answers_a_user_with_one_list(spark, inter):
    """Similarities that fit one block give each user one packed row, so rows that travel do not grow with blocks of a fixed number."""
    users = pa.table({"user_id": [5, 6], "_size": [2, 1], "_h": [[{"_m": 0, "_w": 1.0}, {"_m": 1, "_w": 0.5}], [{"_m": 9, "_w": 1.0}]]})
    for near in ([(0, 2), (1, 2), (0, 1), (1, 0)], [(0, 2), (1, 2), *((100 + i, 200 + i) for i in range(9))]):
        table = pa.table({"_m": pa.array([a for a, _ in near], pa.int32()), "_o": pa.array([b for _, b in near], pa.int32()), "similarity": [0.5] * len(near)})
        got = r._best_of_block(3, True)(users, table).to_pylist()
        assert got == [{"user_id": 5, "_os": [2], "_scores": [0.375]}, {"user_id": 6, "_os": [], "_scores": []}]
    plan = r.recommend(inter, r.item_similarity(inter), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_zip" in plan


def test_pairs_met_very_often_travel_as_sums(spark):
    """Few items in many keys: sums by pair of whole tasks travel, not every key's lists; the sums are the same."""
    df = spark.range(900).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("m")).withColumn("c", F.col("m") + F.col("k") % 3)
    got = pair_sums(df, "k", "m", "c")
    want = {(a, b): float(sum((a + k % 3) * (b + k % 3) for k in range(900))) for a in range(1, 6) for b in range(a + 1, 6)}
    assert {(x["a"], x["b"]): x["total"] for x in got.collect()} == want
    assert not re.search(r"hashpartitioning\(_a#\d+, \d+\), REPARTITION_BY_NUM", got._jdf.queryExecution().executedPlan().toString())


def test_popular_lists_take_n_rows_a_user(spark):
    """Only the places of a list become rows: no ranking by user follows.  Odd rows: no user, no merchant, repeated rows, short lists."""
    rows = [(1, "a", 5), (1, "a", 5), (1, None, 1), (2, "b", 2), (None, "a", 1), (3, "c", 1), (3, "b", 1), (3, "a", 1)]
    inter = spark.createDataFrame(rows, "user_id long, merchant string, cnt long")
    lists = r.recommend_popular(inter, 2)
    got = {(x["user_id"], x["rank"]): x["merchant"] for x in lists.collect()}
    assert got == {(1, 1): "b", (1, 2): None, (2, 1): "a", (2, 2): None, (None, 1): "a", (None, 2): "b", (3, 1): None}
    assert "Window" not in lists._jdf.queryExecution().optimizedPlan().toString()
    whole = {(x["user_id"], x["rank"]): x["merchant"] for x in r.recommend_popular(inter, 2, False).collect()}
    assert whole == {(u, k): m for u in (1, 2, 3, None) for k, m in ((1, "a"), (2, "b"))}


def test_pairs_met_very_often_are_added_in_arrays(spark):
    """No row per key and pair is made in the plan; lists of one item and of several lengths are all counted."""
    few = F.expr("filter(sequence(1, 6), x -> x <= 1 + k % 6)")
    df = spark.range(1200).select(F.col("id").alias("k")).select("k", F.explode(few).alias("m")).withColumn("c", F.col("m") + F.col("k") % 3)
    got = pair_sums(df, "k", "m", "c")
    keys = {(a, b): [k for k in range(1200) if 1 + k % 6 >= b] for a in range(1, 7) for b in range(a + 1, 7)}
    assert {(x["a"], x["b"]): x["total"] for x in got.collect()} == {(a, b): float(sum((a + k % 3) * (b + k % 3) for k in ks)) for (a, b), ks in keys.items()}
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_one_block_are_ranked_in_place(inter):
    """One block holds all of a user's scores: no window and no shuffle by user follows."""
    plan = r.recommend(inter, r.item_similarity(inter), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" not in plan


@pytest.mark.parametrize("owned, chunk, half", [(1, 2_000_000, 1), (1, 50, 2), (0.02, 50, 1)])
def test_lists_travel_once_per_block_of_items(spark, counts, monkeypatch, owned, chunk, half):
    """Blocks of owners, also such as need several tasks or many rounds, give the sums of all pairs; whole and broken weights."""
    monkeypatch.setattr(distributed, "PAIR_OWNED", owned)
    monkeypatch.setattr(distributed, "PAIR_CHUNK", chunk)
    want, rows = {}, {}
    for (u, m), c in counts.items():
        rows.setdefault(u, []).append((m, c / half))
    for items in rows.values():
        for a, x in items:
            for b, y in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + x * y
    df = spark.createDataFrame([(u, m, c / half) for (u, m), c in counts.items()] + [(None, "m01", 3.0), (7, None, 1.0)], "user_id long, merchant string, w double")
    got = pair_sums(df, "user_id", "merchant", "w", task=200)
    assert {(x["a"], x["b"]): x["total"] for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "direct_shuffle_partition_id" in plan and "slice(" not in plan


def test_small_tables_of_merchants_and_blocks_are_written(inter):
    """What joins pairs, similarities or histories is a table of known size, so they are not dealt out for the join."""
    sim = r.item_similarity(inter)
    dots = pair_sums(inter, "user_id", "merchant", "cnt")
    for plan in (r._cosines(dots, inter), r.recommend(inter, sim, 3, block=90)):
        assert "Aggregate" not in plan._jdf.queryExecution().optimizedPlan().toString()
