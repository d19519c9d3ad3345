"""Scans, schema handling, property extraction and write jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidelens.catalog import bindings as b
from tidelens.catalog.bindings import EV, ORD, STEPS
from tidelens.catalog.commerce import SLOT, top_sql, with_new_customers
from tidelens.catalog.recommendations import COMPARED, COMPARED_ROUNDED
from tidelens.catalog.registry import query, twin
from tidelens.catalog.users import _COH
from tidelens.operators import segments
from tidelens.plans import jobs
from tidelens.schema import EventSchema
from tidelens.session import checkpoint_dir
from tidelens.sources import events as ev
from tidelens.sources import normalise, sinks

V = b.VOCAB
RAW = EventSchema(
    user="user_id", time="ts", properties="props", event_id="event_id", required=("user_id", "event_type", "ts"), optional=()
)


def _scratch(spark) -> str:
    """A new folder in the shared checkpoint directory for write-and-read-back queries."""
    return f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"


_RAW_SQL = "SELECT event_id, ts, user_id, event_type, value, props FROM events"


@query("src01_load_file", _RAW_SQL)
def _(spark, sf):
    return ev.load(spark, f"{sf}/events.parquet", schema=RAW)


@query("src05_load_data", _RAW_SQL)
def _(spark, sf):
    return ev.load_data(spark, f"{sf}/events.parquet", RAW)


@query("src01_csv_round_trip", "SELECT event_id, user_id, event_type, ts AS event_time FROM events")
def _(spark, sf):
    path = _scratch(spark) + ".csv"
    src = b.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("event_id"), F.col("user_id").alias("amplitude_id"), "event_type",
        F.col("ts").cast("timestamp").alias("event_time"), F.lit("IOS").alias("platform"),
    )
    src.write.option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)
    df = ev.load(spark, path)
    return df.select(F.col("event_id").cast("long").alias("event_id"), F.col("amplitude_id").alias("user_id"), "event_type", "event_time")


def _two_files(spark, sf):
    path = _scratch(spark) + "/late.parquet"
    b.table(spark, sf, "events").where(F.col("user_id") % 3 == 0).write.parquet(path)
    return ev.load_multiple(spark, [f"{sf}/events.parquet", path, f"{sf}/absent.parquet"], schema=RAW, skipped={})


@query(
    "src02_load_multiple",
    """SELECT 'events.parquet' AS _source_file, count(*) AS n FROM events UNION ALL SELECT 'late.parquet', count(*) FROM events WHERE user_id % 3 = 0""",
)
def _(spark, sf):
    return _two_files(spark, sf).groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dsh12_files_per_user",
    "WITH u AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS files FROM events GROUP BY 1) SELECT files, count(*) AS users FROM u GROUP BY 1",
)
def _(spark, sf):
    return ev.files_per_user(_two_files(spark, sf))


@query("src03_load_date_range", _RAW_SQL + " WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def _(spark, sf):
    return ev.load_date_range(spark, sf, "2024-01-05", "2024-01-10", "events.parquet", RAW).drop("_source_file")


@query("src04_load_folder", "SELECT 'events.parquet' AS _source_file, count(*) AS n FROM events")
def _(spark, sf):
    return ev.load_folder(spark, sf, "events.parquet", RAW).groupBy("_source_file").agg(F.count(F.lit(1)).alias("n"))


@query("src07_canonical", f"WITH {EV} SELECT user_id, event_time, event_type, event_id, NULL::VARCHAR AS platform, props AS event_properties, order_total AS value FROM ev")
def _(spark, sf):
    return ev.canonical(b.table(spark, sf, "events"), RAW)


@query("src08_parse_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    df = ev.parse_event_properties(b.events(spark, sf))
    return df.select("event_id", F.try_variant_get("props", "$.k", "int").alias("k"))


@query("src09_extract_property", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS absent FROM events")
def _(spark, sf):
    df = ev.extract_property(ev.extract_property(b.events(spark, sf), "k"), "absent", "none")
    return df.select("event_id", "k", "absent")


def _filtered(name: str, types: tuple[str, ...], fn) -> None:
    @query(name, f"SELECT event_id, event_type FROM events WHERE event_type IN ({', '.join(repr(t) for t in types)})")
    def _(spark, sf):
        return fn(b.events(spark, sf)).select("event_id", "event_type")


_filtered("src10_filter_events", ("click", "error"), lambda e: ev.filter_events(e, ["click", "error"]))
_filtered("src11_funnel_events", STEPS, lambda e: ev.funnel_events(e, V))
_filtered("src12_order_events", V.order_events, lambda e: ev.order_events(e, V))


@query("src13_summary", f"WITH {EV} SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_users, min(event_time) AS first_event, max(event_time) AS last_event FROM ev")
def _(spark, sf):
    return ev.summary(b.events(spark, sf))


@query("src13_counts_by_type", "SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def _(spark, sf):
    return ev.counts_by(b.events(spark, sf), "event_type")


@query("src13_counts_by_platform", f"WITH {EV} SELECT platform, count(*) AS events FROM ev GROUP BY 1")
def _(spark, sf):
    return ev.counts_by(b.events(spark, sf), "platform")


# --- property extraction over JSON events derived from the order tables -------------------------


def _json_orders(spark, sf, flat: bool = False):
    """Order events with JSON properties (or flat columns for the names), one per line item."""
    o = b.orders(spark, sf)
    props = F.to_json(
        F.struct(
            "order_id",
            "order_total",
            "order_type",
            *([] if flat else [F.col("merchant").alias("merchant_name"), "merchant_id"]),
            F.col("category").alias("category_name"),
            F.col("quantity").alias("products_quantity"),
            "payment_method",
            "delivery_fee",
            F.when(F.col("user_id") % 2 == 0, F.col("promo_code")).alias("promo_code"),
            F.when(F.col("user_id") % 2 == 1, F.col("promo_code")).alias("coupon_code"),
            "discount_amount",
            (F.col("user_id") % 5 == 0).alias("group_order"),
        )
    )
    out = o.select(
        "user_id", "event_time", "event_id", F.lit(V.order).alias("event_type"), "platform", props.alias("event_properties"), "merchant", "merchant_id"
    )
    if flat:
        return out.withColumnsRenamed({"merchant": "event_data_merchant_name", "merchant_id": "event_data_merchant_id"})
    return out.drop("merchant", "merchant_id")


_ORDERS_SQL = f"""WITH {ORD} SELECT user_id, event_time, event_id, platform, order_id, merchant, category, order_total, delivery_fee, quantity, payment_method,
 promo_code, has_promo, discount_amount FROM o"""
_ORDER_COLS = (
    "user_id event_time event_id platform order_id merchant category order_total delivery_fee quantity payment_method promo_code has_promo discount_amount"
).split()


@query("src23_orders_from_json", _ORDERS_SQL)
def _(spark, sf):
    return normalise.orders_frame(_json_orders(spark, sf), V).select(*_ORDER_COLS)


@query("src19_orders_from_flat_columns", _ORDERS_SQL)
def _(spark, sf):
    return normalise.orders_frame(_json_orders(spark, sf, flat=True), V).select(*_ORDER_COLS)


@query("src16_order_total_and_type", f"WITH {ORD} SELECT event_id, order_total, o_orderpriority AS order_type FROM o JOIN orders ON o_orderkey = CAST(order_id AS BIGINT)")
def _(spark, sf):
    df = normalise.with_order_type(normalise.with_order_total(_json_orders(spark, sf)))
    return df.select("event_id", "order_total", "order_type")


@query("src18_order_value", f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'purchase' THEN order_total END AS order_value FROM ev")
def _(spark, sf):
    return normalise.with_order_value(b.events(spark, sf), V).select("event_id", "order_value")


@query(
    "src24_order_properties",
    f"""WITH {ORD} SELECT event_id, quantity AS products_quantity, user_id % 2 = 0 AND promo_code IS NOT NULL AS uses_promo, user_id % 5 = 0 AS is_group_order FROM o""",
)
def _(spark, sf):
    df = normalise.order_properties(_json_orders(spark, sf))
    return df.select("event_id", "products_quantity", "uses_promo", "is_group_order")


@query(
    "src25_searches_from_json",
    """SELECT event_id, 'term ' || json_extract_string(props, '$.k') AS query, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 4 AS DOUBLE) AS results_count,
 CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0 AS zero_results FROM events WHERE event_type = 'view'""",
)
def _(spark, sf):
    e = b.events(spark, sf)
    k = F.get_json_object("event_properties", "$.k")
    text = F.concat(F.lit("  TERM "), k, F.lit(" "))
    way = F.col("event_id") % 3
    props = F.to_json(
        F.struct(
            F.when(way == 0, text).alias("search_query"),
            F.when(way == 1, text).alias("query"),
            F.when(way == 2, text).alias("search_term"),
            F.when(way == 0, k.cast("int") % 4).alias("results_count"),
            F.when(way != 0, k.cast("int") % 4).alias("num_results"),
        )
    )
    s = normalise.searches_frame(e.withColumn("event_properties", props), V)
    return s.select("event_id", "query", "results_count", "zero_results")


@query(
    "src26_delivery_match",
    """SELECT o_orderkey AS event_id, o_totalprice AS order_total, l_shipdate AS delivered_at,
 (epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0::DOUBLE AS minutes FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey""",
)
def _(spark, sf):
    o = b.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.col("o_orderkey").alias("event_id"),
        F.lit(V.order).alias("event_type"),
        F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_totalprice").alias("order_total"))).alias("event_properties"),
    )
    d = b.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("event_time"), F.lit(V.delivered).alias("event_type"),
        F.to_json(F.struct(F.col("l_orderkey").cast("string").alias("order_id"))).alias("event_properties"),
    )
    m = normalise.match_deliveries(normalise.checkouts_frame(o, V), normalise.delivered_frame(d, V))
    return m.select("event_id", "order_total", "delivered_at", "minutes")


@query(
    "src27_order_lines",
    """SELECT l_orderkey AS event_id, CASE l_orderkey % 4 WHEN 0 THEN 'P' || l_partkey WHEN 3 THEN 'order_' || l_orderkey ELSE 'N' || l_partkey END AS product_id,
 CASE l_orderkey % 4 WHEN 3 THEN 'Order from shop' ELSE 'N' || l_partkey END AS product_name, CASE WHEN l_orderkey % 4 IN (0, 3) THEN l_quantity ELSE 1 END AS quantity,
 CASE l_orderkey % 4 WHEN 0 THEN l_extendedprice WHEN 3 THEN l_extendedprice ELSE 0 END AS price FROM lineitem""",
)
def _(spark, sf):
    """The four shapes of order contents: product objects, product names, a name list, nothing."""
    li = b.table(spark, sf, "lineitem")
    way = F.col("l_orderkey") % 4
    name = F.concat(F.lit("N"), F.col("l_partkey").cast("string"))
    obj = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_id"), name.alias("product_name"),
                    F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                )
            ).alias("products"),
            F.col("l_orderkey").cast("string").alias("order_id"),
        )
    )
    props = (
        F.when(way == 0, obj)
        .when(way == 1, F.to_json(F.struct(F.array(name).alias("products"))))
        .when(way == 2, F.to_json(F.struct(F.array(name).alias("product_names"))))
        .otherwise(
            F.to_json(
                F.struct(
                    F.col("l_orderkey").cast("string").alias("order_id"), F.lit("shop").alias("merchant_name"),
                    F.col("l_quantity").alias("products_quantity"), F.col("l_extendedprice").alias("order_total"),
                )
            )
        )
    )
    e = li.select(
        F.col("l_suppkey").alias("user_id"), F.col("l_shipdate").cast("timestamp").alias("event_time"), F.col("l_orderkey").alias("event_id"),
        F.lit(V.order).alias("event_type"), props.alias("event_properties"),
    )
    return normalise.order_lines_frame(e, V).select("event_id", "product_id", "product_name", "quantity", "price")


# --- sinks and jobs -----------------------------------------------------------------------------


@query("src29_export_segment", "SELECT user_id, 'purchase gte 10' AS segment_filters FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING count(*) >= 10")
def _(spark, sf):
    path = _scratch(spark)
    segments.Segment(b.events(spark, sf), V).ordered_at_least(10).export(path)
    return spark.read.option("header", True).schema("user_id long, segment_filters string").csv(path)


@query("src30_export_stamped", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click'")
def _(spark, sf):
    u = segments.Segment(b.events(spark, sf), V).did_event("click").users()
    path = sinks.export_segment(u, "clickers", _scratch(spark), "20240131_000000")
    return spark.read.option("header", True).schema("user_id long").csv(path).select("user_id")


_HEAT = ", ".join(f"max(CASE WHEN period = {k} THEN active_users::DOUBLE / cohort_size * 100 END) AS p{k}" for k in range(9))


@query("src31_cohort_job", f"WITH {_COH.format(n=7)} SELECT cohort, {_HEAT} FROM rt GROUP BY 1", " ".join(f"p{k}" for k in range(9)))
def _(spark, sf):
    """Runs the cohort job and reads its retention table back."""
    paths = jobs.cohort_analysis(b.events(spark, sf), _scratch(spark), "first_visit_week", V)
    return spark.read.parquet(paths["retention"])


# Jobs run once in a session; every table they write is compared.
_WRITTEN: dict[tuple[str, str, str], dict[str, str]] = {}


def _written(spark, sf: str, job: str, run) -> dict[str, str]:
    key = (spark.sparkContext.applicationId, sf, job)
    if key not in _WRITTEN:
        _WRITTEN[key] = run(_scratch(spark))
    return _WRITTEN[key]


def _explored(name: str, table: str, of: str) -> None:
    @twin(name, of)
    def _(spark, sf):
        return spark.read.parquet(_written(spark, sf, "exploration", lambda out: jobs.exploration(b.events(spark, sf), out, V))[table])


def _trending(name: str, table: str, of: str, source=b.orders) -> None:
    @twin(name, of)
    def _(spark, sf):
        return spark.read.parquet(_written(spark, sf, f"trending-{source.__name__}", lambda out: jobs.trending_tables(source(spark, sf), out))[table])


_explored("src33_headline", "headline", "dsh01_headline")
_explored("src33_bands_written", "order_bands", "src33_order_bands")
_explored("src33_platforms", "platforms", "src13_counts_by_platform")


@query(
    "src33_exploration_job",
    f"""WITH {EV} SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, count(*)::DOUBLE / (SELECT count(*) FROM ev) * 100 AS pct FROM ev GROUP BY 1""",
    "pct",
)
def _(spark, sf):
    paths = jobs.exploration(b.events(spark, sf), _scratch(spark), V)
    return spark.read.parquet(paths["event_shares"])


@query("src43_trending_job", f"WITH {ORD} " + top_sql(f"SELECT {SLOT} AS time_slot, merchant, count(*) AS order_count, count(DISTINCT user_id) AS unique_customers FROM o GROUP BY 1, 2", "order_count DESC, merchant", 10, "time_slot"))
def _(spark, sf):
    """Runs the trending job and reads its slot table back."""
    paths = jobs.trending_tables(b.orders(spark, sf), _scratch(spark))
    return spark.read.parquet(paths["popular_by_slot"])


for _name, _table, _of in (
    ("src43_popular_now", "popular_now", "tre02_popular_now"),
    ("src43_per_platform", "popular_per_platform", "tre04_popular_per_platform"),
    ("src43_velocity", "velocity", "tre05_velocity"),
    ("src43_categories", "categories", "tre06_categories"),
    ("src43_repeat_customers", "repeat_favorites", "tre08_repeat_favorites"),
    ("src43_weekend_weekday", "weekend_vs_weekday", "tre09_weekend_weekday"),
    ("src43_summary", "summary", "tre11_summary"),
):
    _trending(_name, _table, _of)
_trending("src43_new_customers", "new_customer_favorites", "tre07_new_customer_favorites", with_new_customers)


def _features(name: str, table: str, of: str) -> None:
    @twin(name, of)
    def _(spark, sf):
        return spark.read.parquet(_written(spark, sf, "features", lambda out: jobs.user_features(b.events(spark, sf), out, V))[table])


_features("src34_user_features", "user_features", "fea01_user_features")
_features("src34_rfm", "rfm", "fea09_rfm")


@twin("src37_funnel_written", "fun01_funnel")
def _(spark, sf):
    return spark.read.parquet(jobs.conversion_funnel(b.events(spark, sf), _scratch(spark), STEPS, V)["conversion_funnel"])


@twin("src38_churn_features_written", "mlb08_churn_features")
def _(spark, sf):
    return spark.read.parquet(jobs.churn_prediction(b.events(spark, sf), None, _scratch(spark), V)["churn_features"])


@twin("src31_cohorts_written", "coh04_first_visit_week")
def _(spark, sf):
    return spark.read.parquet(_written(spark, sf, "cohorts", lambda out: jobs.cohort_analysis(b.events(spark, sf), out, "first_visit_week", V))["cohorts"])


@twin("src31_second_orders_written", "coh10_time_to_second_order")
def _(spark, sf):
    return spark.read.parquet(_written(spark, sf, "cohorts", lambda out: jobs.cohort_analysis(b.events(spark, sf), out, "first_visit_week", V))["time_to_second_order"])


@query("src34_features_job", "SELECT user_id, count(*) AS total_events FROM events GROUP BY 1")
def _(spark, sf):
    paths = jobs.user_features(b.events(spark, sf), _scratch(spark), V)
    return spark.read.parquet(paths["user_features"]).select("user_id", "total_events")


@query("src37_conversion_job", "SELECT event_type AS step, count(DISTINCT user_id) AS users, count(*) AS events FROM events WHERE event_type <> 'error' GROUP BY 1")
def _(spark, sf):
    paths = jobs.conversion_funnel(b.events(spark, sf), _scratch(spark), STEPS, V)
    return spark.read.parquet(paths["conversion_funnel"]).select("step", "users", "events")


@query("src38_churn_features_job", "SELECT user_id, count(*) AS total_events FROM events GROUP BY 1")
def _(spark, sf):
    """Without a future period the churn job writes its features only."""
    paths = jobs.churn_prediction(b.events(spark, sf), None, _scratch(spark), V)
    return spark.read.parquet(paths["churn_features"]).select("user_id", "total_events")


@query("src42_recommendation_job", COMPARED, COMPARED_ROUNDED)
def _(spark, sf):
    """Evaluation table written by the recommendation job; the split is by order date."""
    o = b.orders(spark, sf)
    cut = F.to_timestamp(F.lit("2000-04-01"))
    paths = jobs.recommendations(o.where(F.col("event_time") < cut), o.where(F.col("event_time") >= cut), _scratch(spark))
    return spark.read.parquet(paths["evaluation"])
