import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidelens.models import features as mf
from tidelens.models.predictors import ChurnPredictor, ConversionPredictor, LtvPredictor, segment_by_ltv
from tidelens.operators import (
    affinity,
    anomalies,
    cohorts,
    features,
    funnels,
    journeys,
    paths,
    reactivation,
    recommender,
    scoring,
    segments,
    sessions,
    survival,
)
from tidelens.operators import evaluation as evl
from tidelens.schema import DEFAULT_VOCABULARY as V

O, H, A = V.order, V.homepage, V.add
DAY = 1440


@pytest.fixture(scope="module")
def history(make_events):
    """Users with 0, 1, 2 and 5 orders over forty days."""
    rows = [(0, 0, H), (0, 5, A), (1, 10, H), (1, 20, O, '{"order_total": 40}')]
    rows += [(2, d * DAY, O, '{"order_total": 60}') for d in (0, 9)]
    rows += [(5, d * DAY + 3, O, '{"order_total": 120, "merchant_name": "M"}') for d in (1, 2, 8, 20, 40)]
    rows += [(5, 40 * DAY, H, None, "android")]
    return make_events(rows)


def test_segment_rules(history):
    s = segments.Segment(history)

    def users(x):
        return {r[0] for r in x.users().collect()}

    assert users(s) == {0, 1, 2, 5}
    assert users(s.never_ordered()) == {0}
    assert users(s.ordered_less_than(2)) == {0, 1}
    assert users(s.event_count(O, "lt", 2)) == {1}  # users without the event never match
    assert users(s.ordered_exactly(0)) == set()
    assert users(s.ordered_at_least(2).on_platform("IOS")) == {2, 5}
    assert users(s.inactive_for_days(30)) == {0, 1, 2}
    assert users(segments.cart_abandoners(history)) == {0}
    assert s.ordered_at_least(2).reset().count().first()[0] == 4
    with pytest.raises(ValueError):
        s.event_count(O, "like", 1)


def test_cohort_and_retention(history):
    c = cohorts.build_cohorts(history, "first_order_week")
    r = {(x["cohort"], x["period"]): x["retention_rate"] for x in cohorts.retention_long(history, c, "week", 6).collect()}
    assert r["2024-02-26/2024-03-03", 0] == 100.0 and len(r) == 7
    assert r["2024-02-26/2024-03-03", 1] == pytest.approx(200 / 3)
    with pytest.raises(ValueError):
        cohorts.build_cohorts(history, "nothing")
    n = {x["user_id"]: x["days_to_nth_order"] for x in cohorts.time_to_nth_order(history, 2).collect()}
    assert n == {2: 9.0, 5: 1.0}


def test_survival_curve_falls(history):
    k = survival.kaplan_meier(history, "churn", churn_days=30).orderBy("time").collect()
    s = [r["survival_probability"] for r in k]
    assert s == sorted(s, reverse=True) and k[0]["n_at_risk"] == sum(r["events"] + r["censored"] for r in k)
    h = {r["period"]: r["users_remaining"] for r in survival.hazard_by_period(history).collect()}
    assert h == {0: 3, 1: 2, 2: 1, 5: 1}


def test_scores_and_halves(history):
    p = {r["user_id"]: r for r in scoring.customer_profiles(history).collect()}
    assert p[5]["first_hits"] == 3 and p[5]["second_hits"] == 2 and p[0]["max_funnel_stage"] == 3
    s = scoring.scored_profiles(scoring.customer_profiles(history))
    stages = {r["user_id"]: r["lifecycle_stage"] for r in s.collect()}
    assert stages == {0: "Browser - Lost", 1: "First Purchase - At Risk", 2: "Repeat - Lapsed", 5: "Repeat - Active"}
    actions = {r["user_id"]: r["action"] for r in scoring.next_best_action(s).collect()}
    assert actions[5] == "Loyalty Rewards" and actions[0] == "Personalized Recommendations"


def test_dormant(history):
    f = reactivation.dormant_features(history, dormancy_days=14)
    rows = {r["user_id"]: r for r in f.collect()}
    assert set(rows) == {0, 1, 2} and rows[2]["avg_order_gap_days"] == 9.0 and rows[2]["total_revenue"] == 120.0
    x = {r["user_id"]: r["incentive_type"] for r in reactivation.with_incentives(reactivation.reactivation_scores(f)).collect()}
    assert x[0] == "skip" and x[1] in ("fixed_discount", "percentage_discount")


def test_rfm_by_hand(make_events):
    rows = [(u, 60 * i + u, O, '{"order_total": %d}' % (u + 1)) for u in range(10) for i in range(u + 1)]
    r = {x["user_id"]: x for x in features.rfm(make_events(rows)).collect()}
    assert [r[u]["F_score"] for u in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [r[u]["R_score"] for u in range(10)] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert r[9]["RFM_segment"] == "Champions" and r[9]["monetary"] == 100.0


def test_rules_need_ten_orders(spark):
    def lines(n):
        return spark.createDataFrame([(i, p) for i in range(n) for p in (("x", "y") if i % 2 else ("x", "z"))], "order_id int, product_name string")

    assert affinity.association_rules(lines(9)).count() == 0
    rules = {(r["antecedent"], r["consequent"]): r for r in affinity.association_rules(lines(12)).collect()}
    assert rules["y", "x"]["confidence"] == 100.0 and rules["x", "y"]["lift"] == pytest.approx(1.0)
    assert ("y", "z") not in rules


def test_recommender_by_hand(spark):
    inter = spark.createDataFrame(
        [(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "b", 1), (2, "c", 1), (3, "c", 1), (4, "d", 1)], "user_id long, merchant string, cnt long"
    )
    sim = recommender.item_similarity(inter)
    s = {(r["merchant"], r["other"]): r["similarity"] for r in sim.collect()}
    assert s["a", "b"] == pytest.approx((1 * 2 + 3 * 1) / (10**0.5 * 5**0.5)) and ("a", "d") not in s
    rec = {(r["user_id"], r["merchant"]) for r in recommender.recommend(inter, sim, 5).collect()}
    assert rec == {(1, "c"), (3, "a"), (3, "b")}
    pop = recommender.recommend_popular(inter, 2).orderBy("user_id", "rank").collect()
    assert [(r["user_id"], r["merchant"]) for r in pop if r["user_id"] == 2] == [(2, "d")]
    assert [(r["user_id"], r["merchant"]) for r in pop if r["user_id"] == 4] == [(4, "a"), (4, "b")]


def test_evaluation_by_hand(spark):
    recs = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 0.5, 2), (1, "c", 0.4, 3), (2, "a", 0.3, 1)], "user_id long, merchant string, score double, rank int")
    truth = spark.createDataFrame([(1, "b"), (1, "c"), (1, "z"), (2, "q"), (3, "a")], "user_id long, merchant string")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    m = {r["user_id"]: r for r in evl.user_metrics(recs, truth, users, (2, 3)).collect()}
    assert m[1]["precision_2"] == 0.5 and m[1]["recall_3"] == pytest.approx(2 / 3) and m[1]["hit_rate_2"] == 1.0
    assert m[1]["map"] == pytest.approx((1 / 2 + 2 / 3) / 3) and m[2]["ndcg_3"] == 0.0 and m[3]["map"] == 0.0


def test_empty_and_orderless_inputs(make_events, spark):
    none = make_events([(1, 0, H)]).where("false")
    no_orders = make_events([(1, 0, H), (2, 1, A)])
    for e in (none, no_orders):
        s = sessions.sessions(e)
        seq = journeys.journey_sequences(e)
        for df in (
            funnels.funnel(e),
            funnels.drop_off_analysis(e),
            funnels.time_between_steps(e),
            sessions.session_summary(s),
            sessions.depth_analysis(s),
            journeys.event_lift(seq),
            journeys.time_between_stages(e),
            paths.paths_to_conversion(e),
            cohorts.retention(e, cohorts.build_cohorts(e)),
            features.rfm(e),
            survival.kaplan_meier(e),
            survival.retention_curve(e),
            scoring.scoring_summary(scoring.scored_profiles(scoring.customer_profiles(e))),
            anomalies.volume_anomalies(e),
            anomalies.user_anomalies(e),
            reactivation.campaign_segments(reactivation.reactivation_scores(reactivation.dormant_features(e))),
        ):
            df.collect()


@pytest.fixture(scope="module")
def many(make_events):
    rows = []
    for u in range(60):
        for i in range(3 + u % 5):
            rows.append((u, u * 7 + i * 200, H))
            rows.append((u, u * 7 + i * 200 + 3, A if u % 2 else V.product_view))
        if u % 3 == 0:
            rows.append((u, u * 7 + 900, O, '{"order_total": %d}' % (20 + u)))
    return make_events(rows)


def test_models_train_score_persist(many, tmp_path):
    cut = F.lit(dt.datetime(2024, 3, 1, 20, 0))
    history, future = many.where(F.col("event_time") < cut), many.where(F.col("event_time") >= cut)
    p = ChurnPredictor("logistic")
    out = p.run(history, future)
    assert 0 <= out["metrics"].first()["accuracy"] <= 1
    p.save(str(tmp_path / "m"))
    q = ChurnPredictor("logistic").load(str(tmp_path / "m"))
    f = mf.churn_features(history)
    a = {r["user_id"]: r["churn_probability"] for r in out["predictions"].collect()}
    assert a == pytest.approx({r["user_id"]: r["churn_probability"] for r in q.predict(f, "churn").collect()})
    assert ConversionPredictor("logistic").run(many)["predictions"].count() == 60
    ltv = segment_by_ltv(LtvPredictor("ridge").run(many)["predictions"])
    assert ltv.count() == 20 and ltv.where("ltv_tier = 'Diamond'").count() == 3
