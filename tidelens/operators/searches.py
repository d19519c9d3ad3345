"""Search analytics over the searches frame (``user_id, event_time, event_id, query, results_count, zero_results``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.functions.columns import (
    INF,
    bins,
    count_if,
    percent,
    ratio,
    round_half_even,
)
from tidelens.operators.promos import rule_rows
from tidelens.operators.sessions import chunked_events, link_partials
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

# Keyword lists by category, tested in this order, and priority bins.
CATEGORIES = (
    ("Fast Food", ("burger", "pizza", "fries", "kfc", "mcdonald", "subway", "wendys", "chicken")),
    ("Asian", ("sushi", "chinese", "thai", "indian", "japanese", "korean", "noodle", "ramen", "curry")),
    ("Arabic/Middle Eastern", ("shawarma", "kebab", "falafel", "hummus", "arabic", "lebanese", "turkish")),
    ("Desserts", ("cake", "ice cream", "dessert", "chocolate", "sweet", "donut", "bakery")),
    ("Coffee/Drinks", ("coffee", "tea", "juice", "smoothie", "starbucks", "cafe")),
    ("Healthy", ("salad", "healthy", "vegan", "vegetarian", "organic", "diet")),
    ("Grocery", ("grocery", "supermarket", "snacks", "water", "milk")),
)
PRIORITY_EDGES = (0, 5, 20, 100, INF)
PRIORITIES = ("Low", "Medium", "High", "Critical")


def _buyers(events: DataFrame, vocab: Vocabulary) -> DataFrame:
    return events.where(F.col("event_type") == vocab.order).select("user_id").distinct()


def search_summary(searches: DataFrame, events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    u = searches.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("zero_results")).alias("z"),
        F.sum("results_count").alias("r"),
    )
    queries = searches.agg(F.countDistinct("query").alias("q"))
    flagged = u.join(_buyers(events, vocab).withColumn("b", F.lit(1)), "user_id", "left")
    g = flagged.agg(
        F.sum("n").alias("total_searches"),
        F.count(F.lit(1)).alias("unique_searchers"),
        F.sum("z").alias("z"),
        F.sum("r").alias("r"),
        F.count("b").alias("b"),
    )
    n = F.col("total_searches")
    return g.select(
        "total_searches",
        "unique_searchers",
        queries.scalar().alias("unique_queries"),
        F.coalesce(round_half_even(ratio(n, F.col("unique_searchers")), 2), F.lit(0.0)).alias("searches_per_user"),
        percent(F.col("z"), n, 1).alias("zero_result_rate"),
        F.coalesce(percent(F.col("b"), F.col("unique_searchers"), 1), F.lit(0.0)).alias("search_to_order_rate"),
        round_half_even(ratio(F.col("r"), n), 1).alias("avg_results_per_search"),
    )


def top_searches(searches: DataFrame, events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, n: int = 50) -> DataFrame:
    """Most frequent queries with the share of their users who ever ordered."""
    per_user = searches.groupBy("query", "user_id").agg(
        F.count(F.lit(1)).alias("n"), count_if(F.col("zero_results")).alias("z"), F.sum("results_count").alias("r")
    )
    g = (
        per_user.join(_buyers(events, vocab).withColumn("b", F.lit(1)), "user_id", "left")
        .groupBy("query")
        .agg(
            F.sum("n").alias("searches"),
            F.count(F.lit(1)).alias("unique_users"),
            F.sum("z").alias("z"),
            F.sum("r").alias("r"),
            F.count("b").alias("b"),
        )
        .orderBy(F.desc("searches"), "query")
        .limit(n)
    )
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("searches"), "query"))  # n rows
    s = F.col("searches")
    return g.select(
        rank.alias("rank"),
        "query",
        "searches",
        "unique_users",
        round_half_even(ratio(F.col("r"), s), 1).alias("avg_results"),
        round_half_even(ratio(F.col("z"), s) * 100, 1).alias("zero_result_rate"),
        round_half_even(ratio(F.col("b"), F.col("unique_users")) * 100, 1).alias("conversion_rate"),
    )


def zero_result_searches(searches: DataFrame, n: int = 30) -> DataFrame:
    g = (
        searches.where(F.col("zero_results"))
        .groupBy("query", "user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("query")
        .agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("unique_users"))
    )
    return g.orderBy(F.desc("occurrences"), "query").limit(n).withColumn(
        "priority", bins(F.col("occurrences"), PRIORITY_EDGES, PRIORITIES)
    )


def search_funnel(searches: DataFrame, events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Searchers who ever did each step, from one flag row per user."""
    steps = (vocab.search, vocab.product_view, vocab.add, vocab.order)
    t = F.col("event_type")
    flags = events.where(t.isin(list(steps))).groupBy("user_id").agg(*[F.max(t == s).alias(f"s{i}") for i, s in enumerate(steps)])
    who = searches.select("user_id").distinct()
    g = flags.join(who, "user_id", "left_semi").agg(*[count_if(F.col(f"s{i}")).alias(f"n{i}") for i in range(4)])
    total = who.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_number"),
                F.initcap(F.lit(s.replace("_", " "))).alias("step"),
                F.coalesce(f"n{i}", F.lit(0)).alias("searchers"),
            )
            for i, s in enumerate(steps)
        ]
    )
    rows = g.select(F.explode(cells).alias("c")).select("c.*")
    return rows.withColumn("pct_of_searchers", F.coalesce(percent(F.col("searchers"), total), F.lit(0.0)))


def searches_by_hour(searches: DataFrame) -> DataFrame:
    g = (
        searches.groupBy(F.hour("event_time").alias("hour"), "user_id")
        .agg(F.count(F.lit(1)).alias("n"), count_if(F.col("zero_results")).alias("z"))
        .groupBy("hour")
        .agg(F.sum("n").alias("searches"), F.count(F.lit(1)).alias("unique_searchers"), F.sum("z").alias("z"))
    )
    return g.select(
        "hour",
        "searches",
        "unique_searchers",
        round_half_even(ratio(F.col("z"), F.col("searches")) * 100, 1).alias("zero_result_rate"),
        round_half_even(ratio(F.col("searches"), F.col("unique_searchers")), 2).alias("searches_per_user"),
    )


def search_categories(searches: DataFrame, categories=CATEGORIES) -> DataFrame:
    """First category with a keyword inside the query, else Other."""
    label = None
    for name, words in categories:
        hit = F.col("query").rlike("|".join(words))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    # distinct (query) rows are few against searches: classify after counting per query and user
    per = searches.groupBy("query", "user_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("zero_results")).alias("z"))
    g = (
        per.groupBy(label.otherwise("Other").alias("category"), "user_id")
        .agg(F.sum("n").alias("n"), F.sum("z").alias("z"))
        .groupBy("category")
        .agg(F.sum("n").alias("searches"), F.count(F.lit(1)).alias("unique_users"), F.sum("z").alias("z"))
    )
    s = F.col("searches")
    return g.select(
        "category",
        "searches",
        "unique_users",
        round_half_even(ratio(F.col("z"), s) * 100, 1).alias("zero_result_rate"),
        percent(s, F.sum("searches").over(Window.partitionBy()), 1).alias("pct_of_searches"),
    )


def _search_sessions(searches: DataFrame, gap_minutes: float) -> DataFrame:
    partials = (
        chunked_events(searches.select("user_id", "event_time", "event_id"), gap_minutes)
        .groupBy("user_id", "chunk", "local")
        .agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.lit(1)).alias("n"))
    )
    return link_partials(partials, gap_minutes).groupBy("user_id", "session_no").agg(F.sum("n").alias("search_count"))


def search_refinements(searches: DataFrame, gap_minutes: float = 10) -> DataFrame:
    """Search sessions by number of searches, with the overall rate of sessions with two or more."""
    s = _search_sessions(searches, gap_minutes).groupBy("search_count").agg(F.count(F.lit(1)).alias("sessions"))
    every = Window.partitionBy()  # one row per distinct session length
    total = F.sum("sessions").over(every)
    multi = F.sum(F.when(F.col("search_count") >= 2, F.col("sessions")).otherwise(0)).over(every)
    return s.select(
        "search_count", "sessions", percent(F.col("sessions"), total, 1).alias("pct"), percent(multi, total, 1).alias("refinement_rate")
    )


def search_recommendations(searches: DataFrame, events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    failed = zero_result_searches(searches, 10).orderBy(F.desc("occurrences"), "query").limit(3).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(-F.col("occurrences"), F.col("query")))), lambda x: x["query"]), ", "
        ).alias("q")
    )
    weak = top_searches(searches, events, vocab, 20).where((F.col("searches") >= 10) & (F.col("conversion_rate") < 10)).agg(
        F.count(F.lit(1)).alias("n")
    )
    facts = search_summary(searches, events, vocab).select(
        "zero_result_rate", "search_to_order_rate", failed.scalar().alias("failed"), weak.scalar().alias("weak")
    )
    return rule_rows(
        facts,
        [
            (
                F.col("zero_result_rate") > 10,
                F.lit("warning"),
                F.format_string("High Zero-Result Rate (%.1f%%)", F.col("zero_result_rate")),
                F.format_string("Top failed searches: %s", F.col("failed")),
                F.lit("Add these items/merchants or improve search matching"),
            ),
            (
                F.col("search_to_order_rate") < 30,
                F.lit("opportunity"),
                F.format_string("Low Search Conversion (%.1f%%)", F.col("search_to_order_rate")),
                F.lit("Users who search are not converting to orders"),
                F.lit("Improve search relevance, add filters, show popular items"),
            ),
            (
                F.col("weak") > 0,
                F.lit("opportunity"),
                F.lit("High-Volume Low-Converting Searches"),
                F.format_string("%d popular searches have <10%% conversion", F.col("weak")),
                F.lit("Review search results quality for these terms"),
            ),
        ],
    )
