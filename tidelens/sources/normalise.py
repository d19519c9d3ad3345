"""Order, search, delivery and basket frames from either layout of the event table.

Properties come from the JSON column or, in the flat layout, from ``event_data_*`` columns.
Each property is projected once into a typed column, so operators never parse JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_MINUTE, first_number, first_text, json_number, json_text, micros, with_json
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

UNKNOWN = "Unknown"
_P = F.col


def _flat(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def _text(df: DataFrame, flat: str | None, *keys: str) -> Column:
    """Flat column first, then the JSON keys."""
    js = json_text(F.col("event_properties"), *keys)
    col = _flat(df, flat) if flat else None
    return js if col is None else F.coalesce(F.nullif(col.cast("string"), F.lit("")), js)


def _number(df: DataFrame, flat: str | None, *keys: str) -> Column:
    js = json_number(F.col("event_properties"), *keys)
    col = _flat(df, flat) if flat else None
    return js if col is None else F.coalesce(col.cast("double"), js)


def _is_true(key: str) -> Column:
    """JSON ``true`` only."""
    return F.coalesce(F.get_json_object("event_properties", f"$.{key}") == "true", F.lit(False))


def _truthy(key: str) -> Column:
    raw = F.get_json_object("event_properties", f"$.{key}")
    return F.coalesce(~raw.isin("", "false", "0", "0.0", "null", "[]", "{}"), F.lit(False))


def with_order_total(events: DataFrame) -> DataFrame:
    """Adds ``order_total``: the direct column where present, else the JSON value, else 0."""
    if "order_total" in events.columns:
        return events
    return events.withColumn("order_total", F.coalesce(json_number(F.col("event_properties"), "order_total"), F.lit(0.0)))


def with_order_type(events: DataFrame) -> DataFrame:
    if "order_type" in events.columns:
        return events
    return events.withColumn("order_type", F.coalesce(json_text(F.col("event_properties"), "order_type"), F.lit("unknown")))


def with_order_value(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, absent: float | None = None) -> DataFrame:
    """Adds ``order_value``: the order total on order rows, NULL on all others and on bad JSON.

    ``absent`` is the value of an order whose properties are valid but name no total.
    """
    if "order_total" in events.columns:
        raw = F.col("order_total").cast("double")
    else:
        raw = F.get_json_object("event_properties", "$.order_total").try_cast("double")
        if absent is not None:
            raw = F.coalesce(raw, F.when(F.try_parse_json("event_properties").isNotNull(), F.lit(float(absent))))
    return events.withColumn("order_value", F.when(F.col("event_type") == vocab.order, raw))


#: Properties that :func:`orders_frame` reads.
_ORDER_KEYS = (
    "order_id merchant_id merchant_name category_name order_total order_type delivery_fee products_quantity payment_method "
    "promo_code coupon_code discount_amount promo_discount"
).split()


def orders_frame(
    events: DataFrame,
    vocab: Vocabulary = DEFAULT_VOCABULARY,
    name_as_id: bool = True,
    keep_unknown: bool = False,
) -> DataFrame:
    """Canonical orders: one row per order event that names a merchant.

    ``name_as_id`` keys merchants by name; ``keep_unknown`` keeps merchants called 'Unknown'.
    """
    o = with_json(events.where(F.col("event_type") == vocab.order), "event_properties", _ORDER_KEYS)

    def text(flat: str | None, *keys: str) -> Column:
        js = first_text(*[F.col(f"_js_{k}") for k in keys])
        col = _flat(o, flat) if flat else None
        return js if col is None else F.coalesce(F.nullif(col.cast("string"), F.lit("")), js)

    def number(*keys: str) -> Column:
        return first_number(*[F.col(f"_js_{k}") for k in keys])

    mid = text("event_data_merchant_id", "merchant_id")
    name = text("event_data_merchant_name", "merchant_name")
    merchant = F.coalesce(name, mid) if name_as_id else F.coalesce(mid, name)
    promo = text(None, "promo_code", "coupon_code")
    out = o.select(
        "user_id",
        "event_time",
        "event_id",
        "platform",
        text("event_data_order_id", "order_id").alias("order_id"),
        merchant.alias("merchant"),
        mid.alias("merchant_id"),
        F.coalesce(text("event_data_category_name", "category_name"), F.lit(UNKNOWN)).alias("category"),
        F.coalesce(number("order_total"), F.lit(0.0)).alias("order_total"),
        F.coalesce(text(None, "order_type"), F.lit("unknown")).alias("order_type"),
        F.coalesce(number("delivery_fee"), F.lit(0.0)).alias("delivery_fee"),
        F.coalesce(number("products_quantity"), F.lit(1.0)).alias("quantity"),
        F.coalesce(text(None, "payment_method"), F.lit("unknown")).alias("payment_method"),
        promo.alias("promo_code"),
        promo.isNotNull().alias("has_promo"),
        F.coalesce(number("discount_amount", "promo_discount"), F.lit(0.0)).alias("discount_amount"),
    )
    keep = F.col("merchant").isNotNull()
    return out.where(keep if keep_unknown else keep & (F.col("merchant") != UNKNOWN))


def order_properties(events: DataFrame) -> DataFrame:
    """Adds the order properties the user features need, as typed columns."""
    return events.select(
        "*",
        F.coalesce(json_number(_P("event_properties"), "products_quantity"), F.lit(0.0)).alias("products_quantity"),
        F.coalesce(json_text(_P("event_properties"), "promo_code") != "N/A", F.lit(False)).alias("uses_promo"),
        _is_true("group_order").alias("is_group_order"),
        (_truthy("multi_cart") | _truthy("multicart")).alias("is_multi_cart"),
        json_text(_P("event_properties"), "merchant_id").alias("merchant_id"),
    )


def searches_frame(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per search with a non-empty query: normalised query, result count, zero-result flag."""
    s = events.where(F.col("event_type") == vocab.search)
    query = F.lower(F.trim(_text(s, "event_data_search_query", "search_query", "query", "search_term")))
    results = F.coalesce(_number(s, "event_data_results_count", "results_count", "num_results"), F.lit(0.0))
    return (
        s.select("user_id", "event_time", "event_id", query.alias("query"), results.alias("results_count"))
        .where(F.col("query").isNotNull() & (F.col("query") != ""))
        .withColumn("zero_results", F.col("results_count") == 0)
    )


def checkouts_frame(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per order for the delivery reports; merchants may be missing."""
    o = events.where(F.col("event_type") == vocab.order)
    return o.select(
        "user_id",
        "event_time",
        "event_id",
        _text(o, "event_data_order_id", "order_id").alias("order_id"),
        _text(o, "event_data_merchant_name", "merchant_name").alias("merchant"),
        F.coalesce(json_number(_P("event_properties"), "order_total"), F.lit(0.0)).alias("order_total"),
        F.coalesce(json_text(_P("event_properties"), "order_type"), F.lit("unknown")).alias("order_type"),
        F.coalesce(json_number(_P("event_properties"), "delivery_fee"), F.lit(0.0)).alias("delivery_fee"),
        json_number(_P("event_properties"), "estimated_delivery_time", "eta_minutes").alias("eta_minutes"),
    )


def delivered_frame(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    d = events.where(F.col("event_type") == vocab.delivered)
    return d.select(
        _text(d, "event_data_order_id", "order_id").alias("order_id"),
        F.col("event_time").alias("delivered_at"),
        json_number(_P("event_properties"), "fulfillment_time", "delivery_time_minutes").alias("fulfillment_time"),
    )


def match_deliveries(checkouts: DataFrame, delivered: DataFrame, unit_us: int = US_PER_MINUTE) -> DataFrame:
    """Checkouts left-joined with deliveries on the order id; ``minutes`` from order to delivery.

    Orders without an id are kept unmatched and take no part in the join, so NULL ids neither meet
    each other nor pile up in one task.
    """
    got = delivered.where(F.col("order_id").isNotNull())
    with_id = checkouts.where(F.col("order_id").isNotNull()).join(got, "order_id", "left")
    without = checkouts.where(F.col("order_id").isNull())
    return with_id.unionByName(without, allowMissingColumns=True).withColumn(
        "minutes", (micros(F.col("delivered_at")) - micros(F.col("event_time"))) / F.lit(float(unit_us))
    )


_PRODUCT = "array<struct<product_id:string,id:string,product_name:string,name:string,quantity:double,price:double>>"


def order_lines_frame(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """One row per order line: ``products`` (objects or names), else ``product_names``, else one line per order.

    Orders whose properties are absent or not valid JSON have no lines.
    """
    o = events.where((F.col("event_type") == vocab.order) & F.try_parse_json("event_properties").isNotNull())
    js = F.col("event_properties")
    products = F.get_json_object(js, "$.products")
    structs = F.from_json(products, _PRODUCT)
    names = F.from_json(products, "array<string>")
    listed = F.from_json(F.get_json_object(js, "$.product_names"), "array<string>")
    as_line = "struct<product_id:string,product_name:string,quantity:double,price:double>"
    from_structs = F.transform(
        structs,
        lambda p: F.struct(
            F.coalesce(p["product_id"], p["id"], F.lit("unknown")).alias("product_id"),
            F.coalesce(p["product_name"], p["name"], F.lit("Unknown")).alias("product_name"),
            F.coalesce(p["quantity"], F.lit(1.0)).alias("quantity"),
            F.coalesce(p["price"], F.lit(0.0)).alias("price"),
        ).cast(as_line),
    )

    def plain(arr: Column) -> Column:
        return F.transform(
            arr, lambda x: F.struct(x.alias("product_id"), x.alias("product_name"), F.lit(1.0).alias("quantity"), F.lit(0.0).alias("price")).cast(as_line)
        )

    total = F.coalesce(json_number(js, "order_total"), F.lit(0.0))
    merchant_name = F.coalesce(_text(o, "event_data_merchant_name", "merchant_name"), F.lit("Unknown Merchant"))
    order_id = F.coalesce(_text(o, "event_data_order_id", "order_id"), F.concat(F.lit("order_"), F.col("event_id").cast("string")))
    synthetic = F.array(
        F.struct(
            F.concat(F.lit("order_"), order_id).alias("product_id"),
            F.concat(F.lit("Order from "), merchant_name).alias("product_name"),
            F.coalesce(json_number(js, "products_quantity"), F.lit(1.0)).alias("quantity"),
            total.alias("price"),
        ).cast(as_line)
    )
    first_is_object = F.ltrim(F.get_json_object(js, "$.products[0]")).startswith("{")
    lines = (
        F.when((F.size(products_or_empty(structs)) > 0) & first_is_object, from_structs)
        .when(F.size(products_or_empty(names)) > 0, plain(names))
        .when(F.size(products_or_empty(listed)) > 0, plain(listed))
        .otherwise(synthetic)
    )
    return (
        o.select(
            "user_id",
            "event_time",
            "event_id",
            order_id.alias("order_id"),
            F.coalesce(_text(o, "event_data_merchant_id", "merchant_id"), F.lit("unknown")).alias("merchant_id"),
            merchant_name.alias("merchant"),
            F.explode(lines).alias("line"),
        )
        .select("user_id", "event_time", "event_id", "order_id", "merchant_id", "merchant", "line.*")
        .where(F.col("product_name").isNotNull())
    )


def products_or_empty(arr: Column) -> Column:
    return F.coalesce(arr, F.array())
