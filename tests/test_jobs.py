from pyspark.sql import functions as F

from tidelens.operators import overview, recommender, trending
from tidelens.plans import jobs
from tidelens.schema import Vocabulary
from tidelens.sources import events as ev

V = Vocabulary(homepage="home", order="buy")


def reads(df) -> int:
    """Scans of the input in the plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_exploration_reads_its_input_once(make_events):
    kinds = ["home", "view", "buy", "buy", "home"]
    events = make_events([(u, i, kinds[(u + i) % 5], None, ["ios", "web", None][u % 3]) for u in range(12) for i in range(u)])
    tables = overview.explored(events, V)
    plain = {
        "headline": overview.headline(events, V),
        "event_shares": overview.event_shares(events),
        "order_bands": overview.order_bands(events, V),
        "platforms": ev.counts_by(events, "platform"),
    }
    for name, df in tables.items():
        assert reads(df) == 0 and rows(df) == rows(plain[name]), name  # all read the stored sets


def test_trending_lists_from_hourly_sums(spark, make_events):
    events = make_events([(u, 37 * i + u, "buy", None, ["ios", "android"][u % 2]) for u in range(9) for i in range(1 + u * 3)])
    orders = events.withColumn("merchant", F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))).withColumn("category", F.col("platform")).withColumn("order_total", F.lit(2.0))
    sums = trending.order_partials(orders)
    assert sums.agg(F.sum("orders_in")).first()[0] == orders.count()
    for of in (
        trending.popular_now,
        trending.popular_by_slot,
        trending.popular_per_platform,
        trending.trending_velocity,
        trending.category_breakdown,
        trending.new_customer_favorites,
        trending.repeat_customer_favorites,
        trending.weekend_vs_weekday,
        trending.summary,
    ):
        assert rows(of(sums)) == rows(of(orders)), of.__name__


def test_trending_job_writes_every_table(spark, make_events, tmp_path):
    events = make_events([(u, 61 * i, "buy") for u in range(6) for i in range(4)])
    orders = events.withColumn("merchant", F.lit("m")).withColumn("category", F.lit("c")).withColumn("order_total", F.lit(1.0))
    paths = jobs.trending_tables(orders, str(tmp_path))
    assert len(paths) == 9 and spark.read.parquet(paths["summary"]).first()["total_orders"] == 24


def test_recommendation_job_shares_tables(spark, make_events, tmp_path, monkeypatch):
    """Interactions, similarities and lists are tables that all results read: nothing is kept in executors, and the interactions are written once."""

    def refused(*_):
        raise AssertionError("persisted")

    monkeypatch.setattr(jobs, "shared", refused)
    written, plain = [], recommender.stored
    monkeypatch.setattr(recommender, "stored", lambda df, name, path=None: written.append(path.rsplit("/", 1)[-1] if path else name) or plain(df, name, path))
    events = make_events([(u, 61 * i + u, "buy") for u in range(8) for i in range(2 + u)])
    orders = events.withColumn("merchant", F.concat(F.lit("m"), ((F.col("event_id") * 7 + F.col("user_id")) % 6).cast("string"))).withColumn("order_total", F.lit(1.0))
    train, test = orders.where("event_id % 3 > 0"), orders.where("event_id % 3 = 0")
    paths = jobs.recommendations(train, test, str(tmp_path), 3, k_values=(2, 4))
    inter = recommender.interactions(train)
    assert written.count("interactions") == 1 and spark.read.parquet(paths["evaluation"]).count() == 2
    assert rows(spark.read.parquet(paths["model_stats"])) == rows(recommender.stats(inter))
    lists = recommender.recommend(inter, recommender.item_similarity(inter), 3).select("user_id", "merchant", "rank")
    assert rows(spark.read.parquet(paths["recommendations"]).select("user_id", "merchant", "rank")) == rows(lists) != []
