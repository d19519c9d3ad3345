"""Basket affinity: pairs, association rules, bundles, upsell, and merchant switching.

Input is the order lines frame (``order_id, user_id, merchant, product_id, product_name, quantity,
price``) or the canonical orders frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.columns import percent, ratio
from tidelens.functions.distributed import distinct_rows, pair_counts, top_pairs, top_per_group, transition_counts


def _orders(lines: DataFrame) -> Column:
    return lines.agg(F.countDistinct("order_id").alias("n")).scalar()


def _same_day(orders: DataFrame, name: str, n: int | None) -> DataFrame:
    o = orders.where(F.col("merchant").isNotNull()).select("user_id", F.to_date("event_time").alias("d"), "merchant")
    pairs = pair_counts(o, ["user_id", "d"], "merchant") if n is None else top_pairs(o, ["user_id", "d"], "merchant", n)
    return pairs.select(F.col("a").alias("merchant_1"), F.col("b").alias("merchant_2"), F.col("count").alias(name))


def merchant_affinity(orders: DataFrame, n: int | None = None) -> DataFrame:
    """Merchant pairs a user orders from on the same day; with ``n`` the most frequent ones, without forming the others."""
    return _same_day(orders.where(F.col("merchant") != "unknown"), "co_occurrence", n)


def complementary_merchants(orders: DataFrame, n: int = 20) -> DataFrame:
    return _same_day(orders, "same_day_orders", n)


def merchant_substitutes(orders: DataFrame, n: int = 20) -> DataFrame:
    """Unordered merchant pairs in consecutive orders of one user."""
    steps = transition_counts(orders.where(F.col("merchant").isNotNull()).withColumn("event_type", F.col("merchant")))
    return (
        steps.where(F.col("event_type") != F.col("next_event"))
        .groupBy(
            F.least("event_type", "next_event").alias("merchant_1"), F.greatest("event_type", "next_event").alias("merchant_2")
        )
        .agg(F.sum("count").alias("switch_count"))
        .orderBy(F.desc("switch_count"), "merchant_1", "merchant_2")
        .limit(n)
    )


def product_pairs(lines: DataFrame, min_support: int = 2, merchant_id: str | None = None) -> DataFrame:
    """Product pairs in at least ``min_support`` orders, with support in percent of orders."""
    src = lines.where(F.col("merchant_id") == merchant_id) if merchant_id else lines
    return pair_counts(src, ["order_id"], "product_name", min_support).select(
        F.col("a").alias("product_1"),
        F.col("b").alias("product_2"),
        F.col("count").alias("co_occurrence"),
        percent(F.col("count"), _orders(src)).alias("support"),
    )


def association_rules(
    lines: DataFrame, min_support: float = 0.01, min_confidence: float = 0.1, min_orders: int = 10
) -> DataFrame:
    """Rules A -> B in both directions with support, confidence (both %), lift and count.

    Products below the support are removed before pairs are formed (a pair cannot exceed its parts).
    """
    baskets = distinct_rows(lines.where(F.col("product_name").isNotNull()), ["order_id", "product_name"])
    total = _orders(lines)
    floor_count = F.greatest(F.ceil(total * F.lit(float(min_support)) - F.lit(1e-9)), F.lit(1))
    items = baskets.groupBy("product_name").agg(F.count(F.lit(1)).alias("freq"))
    pairs = pair_counts(baskets, ["order_id"], "product_name", floor_count, distinct=True)
    # each pair meets its two items' numbers once, then becomes two rules
    counted = (
        pairs.where(total >= min_orders)
        .where(ratio(F.col("count"), total) >= min_support)
        .join(items.select(F.col("product_name").alias("a"), F.col("freq").alias("_na")), "a")
        .join(items.select(F.col("product_name").alias("b"), F.col("freq").alias("_nb")), "b")
    )

    def rule(x: str, y: str, nx: str, ny: str) -> Column:
        return F.struct(F.col(x).alias("antecedent"), F.col(y).alias("consequent"), F.col(nx).alias("_fa"), F.col(ny).alias("_fb"))

    both = counted.select("count", F.explode(F.array(rule("a", "b", "_na", "_nb"), rule("b", "a", "_nb", "_na"))).alias("r")).select("count", "r.*")
    confidence = ratio(F.col("count"), F.col("_fa"))
    return both.where(confidence >= min_confidence).select(
        "antecedent",
        "consequent",
        percent(F.col("count"), total).alias("support"),
        (confidence * 100).alias("confidence"),
        F.try_divide(confidence, ratio(F.col("_fb"), total)).alias("lift"),
        "count",
    )


def positive_rules(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("lift") > 1)


def _by_lift() -> list[Column]:
    # lift of A->B and B->A differ only in the last digits: compare on a rounded lift
    return [F.desc(F.round("lift", 9)), F.desc("count"), F.asc("antecedent"), F.asc("consequent")]


def bundles(rules: DataFrame, top_n: int = 10) -> DataFrame:
    """Best unordered pairs with lift above 1.5 out of the ``2 * top_n`` best rules."""
    best = rules.where(F.col("lift") > 1.5).orderBy(*_by_lift()).limit(2 * top_n)
    pair = [F.least("antecedent", "consequent").alias("_a"), F.greatest("antecedent", "consequent").alias("_b")]
    one = top_per_group(best.select("*", *pair), ["_a", "_b"], _by_lift(), 1)
    a, c = F.col("antecedent"), F.col("consequent")
    return (
        one.orderBy(*_by_lift())
        .limit(top_n)
        .select(
            a.alias("product_1"),
            c.alias("product_2"),
            "lift",
            "confidence",
            F.format_string("Customers who buy '%s' often also buy '%s'", a, c).alias("recommendation"),
            F.when(F.col("lift") > 2, "strong").otherwise("moderate").alias("bundle_strength"),
        )
    )


def cross_sell(rules: DataFrame, product_name: str, top_n: int = 5) -> DataFrame:
    return (
        rules.where(F.lower("antecedent") == product_name.lower())
        .orderBy(*_by_lift())
        .limit(top_n)
        .select(
            F.col("consequent").alias("recommended_product"),
            "confidence",
            "lift",
            F.format_string("%.0f%% of customers who bought this also bought %s", F.rint("confidence"), F.col("consequent")).alias("reason"),
        )
    )


def merchant_top_bundles(lines: DataFrame) -> DataFrame:
    """Most frequent product pair of every merchant, all merchants in one pass."""
    top = top_pairs(lines, ["order_id"], "product_name", 1, by=["merchant"])
    totals = lines.groupBy("merchant").agg(F.countDistinct("order_id").alias("total_orders"))
    return top.join(totals, "merchant").select(
        "merchant",
        F.col("a").alias("product_1"),
        F.col("b").alias("product_2"),
        F.col("count").alias("co_occurrence"),
        "total_orders",
    )


def upsell(lines: DataFrame, n: int = 10, suggestions: int = 3) -> DataFrame:
    """Products most often bought alone and what other orders add to them."""
    sizes = lines.groupBy("order_id").agg(F.count(F.lit(1)).alias("_items"))
    sized = lines.select("order_id", "product_name").join(sizes, "order_id")
    alone = (
        sized.where(F.col("_items") == 1)
        .groupBy(F.col("product_name").alias("base_product"))
        .agg(F.count(F.lit(1)).alias("single_orders"))
        .orderBy(F.desc("single_orders"), "base_product")
        .limit(n)
    )
    multi = sized.where(F.col("_items") > 1).select("order_id", "product_name")
    # n base products at most: each order meets itself at most n times
    bases = multi.join(F.broadcast(alone), multi["product_name"] == alone["base_product"]).select("order_id", "base_product").distinct()
    co = (
        multi.join(bases, "order_id")
        .where(F.col("product_name") != F.col("base_product"))
        .groupBy("base_product", "product_name")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    top = top_per_group(co, ["base_product"], [F.desc("c"), F.asc("product_name")], suggestions)
    wide = top.groupBy("base_product").agg(
        *[F.max(F.when(F.col("rank") == i, F.col("product_name"))).alias(f"upsell_suggestion_{i}") for i in range(1, suggestions + 1)]
    )
    return alone.join(wide, "base_product")


def affinity_summary(lines: DataFrame) -> DataFrame:
    per_order = lines.groupBy("order_id").agg(F.count("product_name").alias("n"))
    products = lines.agg(F.countDistinct("product_name").alias("n")).scalar()
    merchants = lines.agg(F.countDistinct("merchant").alias("n")).scalar()
    return per_order.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.avg("n").alias("avg_basket_size"),
        F.max("n").alias("max_basket_size"),
        (F.avg((F.col("n") > 1).cast("double")) * 100).alias("multi_item_order_rate"),
    ).select("*", products.alias("unique_products"), merchants.alias("unique_merchants"))
