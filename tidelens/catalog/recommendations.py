"""Recommender, its evaluation and the CRM segments: users are customers, merchants are suppliers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import ORD
from tidelens.catalog.registry import query
from tidelens.functions.tables import new_path, stored
from tidelens.operators import crm, evaluation, factors, recommender

SPLIT = "2000-04-01"
M1, M2, M3 = "Supplier#000000003", "Supplier#000000007", "Supplier#000000005"


def _inter(spark, sf):
    return recommender.interactions(b.orders(spark, sf))


_FITTED: dict[tuple[str, str, str], recommender.ItemItemRecommender] = {}


def fitted(spark, sf: str, part: str = "all") -> recommender.ItemItemRecommender:
    """The recommender of all orders or of those before the split: fitted once in a session, then read from its stored tables."""
    key = (spark.sparkContext.applicationId, sf, part)
    if key not in _FITTED:
        inter = _inter(spark, sf) if part == "all" else _train_test(spark, sf)[0]
        _FITTED[key] = recommender.ItemItemRecommender.fit(inter)
    return _FITTED[key]


_LISTS: dict[tuple[str, str, str], dict[int, DataFrame]] = {}


def lists(spark, sf: str, n: int, part: str = "all") -> DataFrame:
    """Each user's list to rank ``n``, from the shortest stored table that goes so far."""
    kept = _LISTS.setdefault((spark.sparkContext.applicationId, sf, part), {})
    if not any(depth >= n for depth in kept):
        kept[n] = stored(fitted(spark, sf, part).recommend(n), "recommended")
    return kept[min(depth for depth in kept if depth >= n)].where(F.col("rank") <= n)


def _train_test(spark, sf):
    o = b.orders(spark, sf)
    cut = F.to_timestamp(F.lit(SPLIT))
    return recommender.interactions(o.where(F.col("event_time") < cut)), recommender.interactions(o.where(F.col("event_time") >= cut))


def rec_sql(source: str, where: str = "", p: str = "") -> str:
    """CTEs of interactions, similarity, scores without ordered merchants and ranked lists; ``p`` prefixes the names."""
    return f"""{p}it AS (SELECT user_id, merchant, count(*) AS cnt FROM {source} {where} GROUP BY 1, 2),
{p}nm AS (SELECT merchant, sqrt(sum(cnt::DOUBLE * cnt)) AS norm FROM {p}it GROUP BY 1),
{p}dt AS (SELECT x.merchant AS a, y.merchant AS z, sum(x.cnt::DOUBLE * y.cnt) AS dot FROM {p}it x JOIN {p}it y ON x.user_id = y.user_id AND x.merchant <> y.merchant GROUP BY 1, 2),
{p}sm AS (SELECT a AS merchant, z AS other, dot / (na.norm * nz.norm) AS similarity FROM {p}dt JOIN {p}nm na ON na.merchant = a JOIN {p}nm nz ON nz.merchant = z),
{p}hs AS (SELECT user_id, count(*) AS h FROM {p}it GROUP BY 1),
{p}sc AS (SELECT i.user_id, other AS merchant, sum(similarity * ln(1 + cnt)) / h AS score FROM {p}it i JOIN {p}sm s ON s.merchant = i.merchant JOIN {p}hs ON {p}hs.user_id = i.user_id GROUP BY 1, 2, h),
{p}rc AS (SELECT user_id, merchant, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, merchant) AS rank
  FROM {p}sc ANTI JOIN {p}it USING (user_id, merchant) WHERE score > 0)"""


REC = f"{ORD}, {rec_sql('o')}"


def pop_sql(n: int, p: str = "") -> str:
    """Popularity lists without ordered merchants."""
    return f"""{p}pp AS (SELECT merchant, CAST(sum(cnt) AS BIGINT) AS orders, sum(cnt)::DOUBLE / (SELECT sum(cnt) FROM {p}it) AS score FROM {p}it GROUP BY 1),
{p}pr AS (SELECT user_id, merchant, score, row_number() OVER (PARTITION BY user_id ORDER BY orders DESC, merchant) AS rank
  FROM (SELECT DISTINCT user_id FROM {p}it) CROSS JOIN {p}pp ANTI JOIN {p}it USING (user_id, merchant) QUALIFY rank <= {n})"""


@query("rec01_interactions", f"WITH {REC} SELECT * FROM it")
def _(spark, sf):
    return _inter(spark, sf)


@query("rec03_popularity", f"WITH {REC}, {pop_sql(10)} SELECT * FROM pp", "score")
def _(spark, sf):
    return recommender.popularity(_inter(spark, sf))


@query("rec04_recommend_popular", f"WITH {REC}, {pop_sql(10)} SELECT * FROM pr", "score")
def _(spark, sf):
    return recommender.recommend_popular(_inter(spark, sf), 10)


@query("rec05_item_similarity", f"WITH {REC} SELECT * FROM sm", "similarity")
def _(spark, sf):
    return recommender.item_similarity(_inter(spark, sf))


@query("rec06_recommend_all", f"WITH {REC} SELECT * FROM rc WHERE rank <= 10", "score")
def _(spark, sf):
    return fitted(spark, sf).recommend(10)


@query("rec07_similar_merchants", f"WITH {REC} SELECT other AS merchant, similarity FROM sm WHERE merchant = '{M1}' ORDER BY round(similarity, 9) DESC, other LIMIT 10", "similarity")
def _(spark, sf):
    return fitted(spark, sf).similar_merchants(M1)


LEAST = 0.34


@query("rec05_similar_above", f"WITH {REC} SELECT * FROM sm WHERE round(similarity, 9) >= {LEAST}", "similarity")
def _(spark, sf):
    """Pairs of a least cosine, by bounds instead of all pairs."""
    return recommender.item_similarity(_inter(spark, sf), min_similarity=LEAST)


@query("rec05_saved_and_loaded", f"WITH {REC} SELECT * FROM sm", "similarity")
def _(spark, sf):
    """The similarity table of a recommender that was saved and loaded again."""
    path = new_path(spark, "saved-recommender")
    fitted(spark, sf).save(path)
    return recommender.ItemItemRecommender.load(spark, path).similarity


@query(
    "rec08_explain",
    f"""WITH {REC} SELECT i.merchant, similarity, cnt AS order_count FROM it i JOIN sm ON sm.merchant = i.merchant AND other = '{M1}'
WHERE user_id = 7 ORDER BY round(similarity, 9) DESC, i.merchant LIMIT 5""",
    "similarity",
)
def _(spark, sf):
    return fitted(spark, sf).explain(7, M1)


@query(
    "rec09_stats",
    f"""WITH {REC}, c AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT merchant) AS m, count(*) AS z, sum(cnt) AS s FROM it)
SELECT u AS n_users, m AS n_merchants, z::DOUBLE / (u::DOUBLE * m) AS matrix_density, s::DOUBLE / u AS avg_orders_per_user, s::DOUBLE / m AS avg_users_per_merchant FROM c""",
    "matrix_density avg_orders_per_user avg_users_per_merchant",
)
def _(spark, sf):
    return recommender.stats(_inter(spark, sf))


@query(
    "rec10_factor_facts",
    f"""WITH {REC}, m AS (SELECT count(DISTINCT merchant) AS m FROM it) SELECT count(*) AS users, CAST(sum(least(10, m - h)) AS BIGINT) AS list_rows, 0::BIGINT AS ordered, max(least(10, m - h)) AS longest, true AS ranked
FROM hs CROSS JOIN m""",
)
def _(spark, sf):
    """What must hold for the lists of a matrix factorisation, whatever its numbers: full lists, no ordered merchant, ranks by score."""
    inter = fitted(spark, sf).inter
    recs = stored(factors.saved_factors(inter, rank=8, iterations=4).recommend(10), "factor-lists")
    ordered = recs.join(inter, ["user_id", "merchant"], "left_semi").agg(F.count(F.lit(1))).scalar()
    users = inter.agg(F.countDistinct("user_id")).scalar()
    per = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.min_by("score", "rank").alias("top"), F.max("score").alias("best"))
    ranked = F.bool_and((F.col("n") == F.col("last")) & (F.col("top") == F.col("best")))
    return per.agg(F.sum("n").alias("list_rows"), F.max("n").alias("longest"), ranked.alias("ranked")).select(users.alias("users"), "list_rows", ordered.alias("ordered"), "longest", "ranked")


@query(
    "rec11_hybrid_lists",
    f"""WITH {REC}, {pop_sql(20)}, fu AS (SELECT user_id, merchant, sum(part) AS score FROM (
 SELECT user_id, merchant, 1.0::DOUBLE / (rank + 60) AS part FROM rc WHERE rank <= 20 UNION ALL SELECT user_id, merchant, 0.5::DOUBLE / (rank + 60) FROM pr) GROUP BY 1, 2)
SELECT user_id, merchant, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, merchant) AS rank FROM fu QUALIFY rank <= 10""",
    "score:9",
)
def _(spark, sf):
    """Lists of the item-item and the popularity recommender fused by rank."""
    inter = fitted(spark, sf).inter
    return factors.hybrid({"item_item": (lists(spark, sf, 20), 1.0), "popularity": (recommender.recommend_popular(inter, 20, table=True), 0.5)}, 10)


@query("dsh13_user_history", f"WITH {REC} SELECT merchant, cnt AS orders FROM it WHERE user_id = 7 ORDER BY cnt DESC, merchant LIMIT 10")
def _(spark, sf):
    return recommender.user_history(_inter(spark, sf), 7)


@query("dsh14_merchant_usage", f"WITH {ORD} SELECT count(*) AS orders, count(DISTINCT user_id) AS customers FROM o WHERE merchant = '{M1}'")
def _(spark, sf):
    return recommender.merchant_usage(_inter(spark, sf), M1)


# --- evaluation -------------------------------------------------------------------------------

K = (5, 10)


def eval_sql(recs: str, p: str = "") -> str:
    """Per-user metrics ``ux`` of the ranked lists in ``recs``; ``p`` prefixes the names."""
    ideal = {k: "CASE " + " ".join(f"WHEN least(rel, {k}) = {m} THEN {sum(1.0 / math.log2(i + 1) for i in range(1, m + 1))!r}::DOUBLE" for m in range(1, k + 1)) + " END" for k in K}
    cols = ", ".join(
        f"""coalesce(h{k}, 0) / {k}.0::DOUBLE AS precision_{k}, coalesce(h{k}, 0)::DOUBLE / rel AS recall_{k},
 (coalesce(h{k}, 0) > 0)::INT::DOUBLE AS hit_rate_{k}, coalesce(d{k} / ({ideal[k]}), 0) AS ndcg_{k}"""
        for k in K
    )
    aggs = ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0.0::DOUBLE END) AS d{k}" for k in K)
    return f"""{p}tr AS (SELECT DISTINCT user_id, merchant FROM o WHERE event_time >= TIMESTAMP '{SPLIT}'),
{p}eu AS (SELECT user_id, count(*) AS rel FROM {p}tr WHERE user_id IN (SELECT user_id FROM it) GROUP BY 1),
{p}hx AS (SELECT r.user_id, r.merchant, rank, row_number() OVER (PARTITION BY r.user_id ORDER BY rank) AS seen FROM {recs} r JOIN {p}tr USING (user_id, merchant) WHERE rank <= {max(K)}),
{p}hp AS (SELECT user_id, {aggs}, sum(seen::DOUBLE / rank) AS ap FROM {p}hx GROUP BY 1),
{p}ux AS (SELECT user_id, {cols}, coalesce(ap / rel, 0) AS map FROM {p}eu LEFT JOIN {p}hp USING (user_id))"""


TRAIN = f"{ORD}, {rec_sql('o', f'''WHERE event_time < TIMESTAMP '{SPLIT}' ''')}"
NAMES = [f"{m}_{k}" for k in K for m in ("precision", "recall", "hit_rate", "ndcg")] + ["map"]
DIV = f"""lx AS (SELECT user_id, merchant, rank FROM rc WHERE rank <= {max(K)} AND user_id IN (SELECT user_id FROM eu)),
ln AS (SELECT user_id, count(*) AS n FROM lx GROUP BY 1),
ls AS (SELECT x.user_id, sum(similarity) AS s FROM lx x JOIN lx y ON x.user_id = y.user_id AND x.rank < y.rank JOIN sm ON sm.merchant = x.merchant AND sm.other = y.merchant GROUP BY 1),
dv AS (SELECT user_id, CASE WHEN coalesce(n, 0) < 2 THEN 1.0::DOUBLE ELSE 1 - coalesce(s, 0) / (n * (n - 1) / 2) END AS diversity FROM eu LEFT JOIN ln USING (user_id) LEFT JOIN ls USING (user_id))"""


def _eval_inputs(spark, sf):
    _, test = _train_test(spark, sf)
    model = fitted(spark, sf, "train")
    return model.inter, test, model.similarity, lists(spark, sf, max(K), "train")


@query("eva08_user_metrics", f"WITH {TRAIN}, {eval_sql('rc')} SELECT * FROM ux", " ".join(NAMES))
def _(spark, sf):
    train, test, _, recs = _eval_inputs(spark, sf)
    truth = evaluation.truth_of(test)
    return evaluation.user_metrics(recs, truth, evaluation.eval_users(train, truth), K)


@query("eva07_diversity", f"WITH {TRAIN}, {eval_sql('rc')}, {DIV} SELECT * FROM dv", "diversity")
def _(spark, sf):
    train, test, sim, recs = _eval_inputs(spark, sf)
    return evaluation.diversity(recs, sim, evaluation.eval_users(train, evaluation.truth_of(test)))


_MEANS = ", ".join(f"avg({n}) AS mean_{n}, stddev_pop({n}) AS std_{n}" for n in NAMES)
_COVER = "(SELECT count(DISTINCT merchant) FROM lx)::DOUBLE / (SELECT count(DISTINCT merchant) FROM it)"


@query(
    "eva09_evaluate_model",
    f"WITH {TRAIN}, {eval_sql('rc')}, {DIV} SELECT count(*) AS n_eval_users, {_MEANS}, {_COVER} AS coverage, (SELECT avg(diversity) FROM dv) AS mean_diversity FROM ux",
    " ".join([*(f"mean_{n}" for n in NAMES), *(f"std_{n}" for n in NAMES), "coverage", "mean_diversity"]),
)
def _(spark, sf):
    train, test, sim, recs = _eval_inputs(spark, sf)
    return evaluation.evaluate(recs, train, test, sim, K)


@query(
    "eva10_popularity_baseline",
    f"""WITH {TRAIN}, {pop_sql(max(K))}, {eval_sql('pr')}
SELECT count(*) AS n_eval_users, {_MEANS}, (SELECT count(DISTINCT merchant) FROM pr WHERE user_id IN (SELECT user_id FROM eu))::DOUBLE / (SELECT count(DISTINCT merchant) FROM it) AS coverage FROM ux""",
    " ".join([*(f"mean_{n}" for n in NAMES), *(f"std_{n}" for n in NAMES), "coverage"]),
)
def _(spark, sf):
    train, test = _train_test(spark, sf)
    return evaluation.evaluate(recommender.recommend_popular(train, max(K)), train, test, None, K).drop("mean_diversity")


_MODEL_COLS = ", ".join(f"avg(precision_{k}) AS p_{k}, avg(recall_{k}) AS r_{k}, avg(hit_rate_{k}) AS hr_{k}, avg(ndcg_{k}) AS ndcg_{k}" for k in K) + ", avg(map) AS map"


COMPARED = f"""WITH {TRAIN}, {pop_sql(max(K))}, {eval_sql('rc')}, {DIV}, {eval_sql('pr', 'q')}
SELECT 'item_item' AS model, {_MODEL_COLS}, {_COVER} AS coverage, (SELECT avg(diversity) FROM dv) AS diversity FROM ux UNION ALL
SELECT 'popularity', {_MODEL_COLS}, (SELECT count(DISTINCT merchant) FROM pr WHERE user_id IN (SELECT user_id FROM eu))::DOUBLE / (SELECT count(DISTINCT merchant) FROM it), NULL FROM qux"""
COMPARED_ROUNDED = " ".join([*(f"{m}_{k}" for k in K for m in ("p", "r", "hr", "ndcg")), "map", "coverage", "diversity"])


@query("eva10_compare_models", COMPARED, COMPARED_ROUNDED)
def _(spark, sf):
    """One row per model."""
    train, test, sim, recs = _eval_inputs(spark, sf)
    models = {"item_item": (recs, sim), "popularity": (recommender.recommend_popular(train, max(K), table=True), None)}
    return evaluation.compare_models(models, train, test, K)


# --- CRM --------------------------------------------------------------------------------------

PROF = """lu AS (SELECT max(us) AS m FROM o),
pf AS (SELECT user_id, min(event_time) AS first_order, max(event_time) AS last_order, count(*) AS order_count, sum(order_total) AS total_revenue, avg(order_total) AS avg_order_value,
 CAST(floor(((SELECT m FROM lu) - max(us)) / 86400000000.0::DOUBLE) AS BIGINT) AS days_since_order,
 CAST(floor(((SELECT m FROM lu) - min(us)) / 86400000000.0::DOUBLE) AS BIGINT) AS days_since_first_order FROM o GROUP BY 1)"""


def wide(n: int) -> str:
    c = ", ".join(f"max(merchant) FILTER (WHERE rank = {i}) AS rec_{i}_id, max(score) FILTER (WHERE rank = {i}) AS rec_{i}_score" for i in range(1, n + 1))
    return f"wd AS (SELECT user_id, {c} FROM rc WHERE rank <= {n} GROUP BY 1)"


def _crm(spark, sf, n):
    o = b.orders(spark, sf)
    model = fitted(spark, sf)
    return o, model.inter, lists(spark, sf, n), crm.order_profiles(o)


@query("crm01_profiles", f"WITH {ORD}, {PROF} SELECT * FROM pf", "total_revenue:3 avg_order_value")
def _(spark, sf):
    return crm.order_profiles(b.orders(spark, sf))


@query(
    "crm02_prospects",
    f"""WITH {REC}, {PROF} SELECT user_id, merchant AS target_merchant, score AS affinity_score, order_count, days_since_order FROM rc JOIN pf USING (user_id)
WHERE rank <= 20 AND merchant = '{M1}' AND score >= 0.05""",
    "affinity_score",
)
def _(spark, sf):
    _, _, recs, prof = _crm(spark, sf, 20)
    return crm.high_affinity_prospects(recs, prof, M1, 0.05, depth=20)


@query(
    "crm03_lapsed",
    f"""WITH {REC}, {PROF}, {wide(3)} SELECT user_id, days_since_order, order_count, total_revenue, avg_order_value, wd.* EXCLUDE (user_id)
FROM pf LEFT JOIN wd USING (user_id) WHERE days_since_order BETWEEN 14 AND 60""",
    "total_revenue:3 avg_order_value rec_1_score rec_2_score rec_3_score",
)
def _(spark, sf):
    _, _, recs, prof = _crm(spark, sf, 3)
    return crm.lapsed_with_recommendations(recs, prof)


@query(
    "crm04_category_explorers",
    f"""WITH {REC}, {PROF}, g AS (SELECT user_id, avg(score) AS avg_category_score, max(score) AS max_category_score, count(*) AS n_relevant_merchants FROM rc
WHERE rank <= 50 AND merchant IN ('{M1}', '{M2}', '{M3}') AND user_id NOT IN (SELECT user_id FROM it WHERE merchant IN ('{M1}', '{M2}', '{M3}')) GROUP BY 1 HAVING avg(score) >= 0.05)
SELECT user_id, 'target' AS category, avg_category_score, max_category_score, n_relevant_merchants, order_count FROM g JOIN pf USING (user_id)""",
    "avg_category_score max_category_score",
)
def _(spark, sf):
    _, i, recs, prof = _crm(spark, sf, 50)
    return crm.category_explorers(recs, i, prof, [M1, M2, M3], "target", 0.05, depth=50)


@query(
    "crm05_superfans",
    f"""WITH {ORD} SELECT merchant, user_id, min(event_time) AS first_order, max(event_time) AS last_order, count(*) AS order_count, sum(order_total) AS total_spent, avg(order_total) AS avg_order_value
FROM o WHERE merchant = '{M1}' GROUP BY 1, 2 ORDER BY order_count DESC, total_spent DESC, user_id LIMIT 100""",
    "total_spent:3 avg_order_value",
)
def _(spark, sf):
    return crm.merchant_superfans(b.orders(spark, sf), M1, 100)


@query(
    "crm06_cross_sell",
    f"""WITH {REC}, {PROF} SELECT user_id, '{M1}' AS source_merchant, merchant AS target_merchant, score AS affinity_score, order_count FROM rc JOIN pf USING (user_id)
WHERE rank <= 50 AND merchant = '{M2}' AND score >= 0.05 AND user_id IN (SELECT user_id FROM it WHERE merchant = '{M1}')""",
    "affinity_score",
)
def _(spark, sf):
    _, i, recs, prof = _crm(spark, sf, 50)
    return crm.cross_sell_targets(recs, i, prof, M1, M2, 0.05, depth=50)


@query(
    "crm07_onboarding",
    f"""WITH {REC}, {PROF}, {wide(5)} SELECT user_id, order_count, days_since_first_order, avg_order_value, wd.* EXCLUDE (user_id) FROM pf LEFT JOIN wd USING (user_id) WHERE order_count <= 25""",
    "avg_order_value rec_1_score rec_2_score rec_3_score rec_4_score rec_5_score",
)
def _(spark, sf):
    _, _, recs, prof = _crm(spark, sf, 5)
    return crm.new_user_onboarding(recs, prof, 25)
