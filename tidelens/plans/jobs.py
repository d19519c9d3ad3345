"""Batch jobs.  Each builds its result frames and writes them; the caller gives the output folder.

Inputs that several results share are persisted for the length of the job (disk spill allowed), or written once as tables.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.functions.tables import stored
from tidelens.models.predictors import (
    ChurnPredictor,
    ConversionPredictor,
    LtvPredictor,
    at_risk_users,
    ltv_tier_summary,
    segment_by_ltv,
)
from tidelens.models.features import churn_features
from tidelens.operators import cohorts, crm, evaluation, features, funnels, overview, recommender, segments, trending
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary
from tidelens.sources.normalise import with_order_total
from tidelens.sources.sinks import write_frames


@contextmanager
def shared(*frames: DataFrame):
    for f in frames:
        f.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frames
    finally:
        for f in frames:
            f.unpersist()


def exploration(events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, str]:
    """All tables come from grouping sets of one pass over the events."""
    return write_frames(overview.explored(events, vocab), output)


def user_features(events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, str]:
    return write_frames(
        {"user_features": features.build_user_features(events, vocab), "rfm": features.rfm(events, vocab)}, output
    )


def segmentation(events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, str]:
    with shared(features.rfm(events, vocab)) as (rfm,):
        return write_frames({"rfm": rfm, "segment_profile": features.rfm_profile(rfm)}, output)


def churn_rule(events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY, window_days: float = 30) -> dict[str, str]:
    with shared(features.churn_rule(events, vocab, window_days)) as (risk,):
        share = risk.groupBy("churn_risk").agg(F.count(F.lit(1)).alias("users"))
        return write_frames({"churn_risk": risk, "churn_summary": share}, output)


def conversion_funnel(events: DataFrame, output: str, steps, vocab: Vocabulary = DEFAULT_VOCABULARY) -> dict[str, str]:
    return write_frames({"conversion_funnel": funnels.funnel(events, steps)}, output)


def churn_prediction(
    history: DataFrame,
    future: DataFrame | None,
    output: str,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    model_type: str = "random_forest",
    threshold: float = 0.7,
    rounds: int = 100,
) -> dict[str, str]:
    """Without a future period only the features are written."""
    if future is None:
        return write_frames({"churn_features": churn_features(history, vocab)}, output)
    p = ChurnPredictor(model_type, vocab, rounds)
    r = p.run(history, future)
    p.save(f"{output.rstrip('/')}/churn_model")
    return write_frames({**r, "at_risk_users": at_risk_users(r["predictions"], threshold)}, output)


def conversion_prediction(
    events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY, model_type: str = "gradient_boosting", level: str = "user", rounds: int = 100
) -> dict[str, str]:
    p = ConversionPredictor(model_type, vocab, rounds)
    r = p.run(events, level)
    p.save(f"{output.rstrip('/')}/conversion_model")
    return write_frames({**r, "high_intent": r["predictions"].where(F.col("conversion_probability") > 0.7)}, output)


def ltv_prediction(
    events: DataFrame, output: str, vocab: Vocabulary = DEFAULT_VOCABULARY, model_type: str = "gradient_boosting", rounds: int = 100
) -> dict[str, str]:
    p = LtvPredictor(model_type, vocab, rounds=rounds)
    r = p.run(events)
    p.save(f"{output.rstrip('/')}/ltv_model")
    with shared(segment_by_ltv(r["predictions"])) as (tiers,):
        return write_frames({**r, "predictions": tiers, "ltv_tiers": ltv_tier_summary(tiers)}, output)


def cohort_analysis(
    events: DataFrame,
    output: str,
    cohort_type: str = "first_order_week",
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    max_periods: int = 8,
    lapsed_days: float = 30,
) -> dict[str, str]:
    orders = with_order_total(events).where(F.col("event_type") == vocab.order).select(
        "user_id", "event_time", "event_id", "event_type", "order_total"
    )
    with shared(orders, cohorts.build_cohorts(events, cohort_type, vocab)) as (o, c):
        return write_frames(
            {
                "cohorts": c,
                "cohort_summary": cohorts.cohort_summary(o, c, vocab),
                "retention": cohorts.retention(o, c, "week", max_periods, vocab),
                "cumulative_ltv": cohorts.cumulative_ltv(o, c, max_periods, vocab),
                "time_to_second_order": cohorts.time_to_nth_order(o, 2, vocab),
                "segment_sizes": segments.predefined_sizes(events, vocab, lapsed_days),
            },
            output,
        )


def recommendations(
    train_orders: DataFrame, test_orders: DataFrame | None, output: str, n: int = 10, min_support: int = 0, k_values=(5, 10)
) -> dict[str, str]:
    """Similarity, lists for all users, CRM segments and, with later orders, the evaluation of both models; what they share are tables."""
    model = recommender.ItemItemRecommender.fit(recommender.interactions(train_orders), min_support=min_support)
    i, sim, depth = model.inter, model.similarity, max(n, *k_values)
    recs = stored(model.recommend(depth), "recommended")
    profiles = crm.order_profiles(train_orders)
    frames = {
        "similarity": sim,
        "recommendations": recs.where(F.col("rank") <= n),
        "model_stats": recommender.stats(i),
        "lapsed_users": crm.lapsed_with_recommendations(recs, profiles),
        "new_users": crm.new_user_onboarding(recs, profiles),
    }
    if test_orders is not None:
        test = recommender.interactions(test_orders)
        popular = recommender.recommend_popular(i, depth, table=True)
        frames["evaluation"] = evaluation.compare_models({"item_item": (recs, sim), "popularity": (popular, None)}, i, test, k_values)
    return write_frames(frames, output)


def trending_tables(orders: DataFrame, output: str, n: int = 10) -> dict[str, str]:
    """All tables come from hourly sums of one pass over the orders."""
    orders = stored(trending.order_partials(orders), "order-partials")
    return write_frames(
        {
            "popular_now": trending.popular_now(orders),
            "popular_by_slot": trending.popular_by_slot(orders, n),
            "popular_per_platform": trending.popular_per_platform(orders, n),
            "velocity": trending.trending_velocity(orders, n),
            "categories": trending.category_breakdown(orders),
            "new_customer_favorites": trending.new_customer_favorites(orders, n),
            "repeat_favorites": trending.repeat_customer_favorites(orders, n),
            "weekend_vs_weekday": trending.weekend_vs_weekday(orders, n),
            "summary": trending.summary(orders),
        },
        output,
    )
