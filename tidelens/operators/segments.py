"""Behavioural segments as predicates over one per-user profile.

Each filter adds a predicate and the aggregates it reads.  ``users()`` runs one group-by over the
event table for all filters together instead of one semi-join per filter.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.columns import US_PER_DAY, count_if, micros
from tidelens.schema import DEFAULT_VOCABULARY, Vocabulary

_COMPARE = {
    "eq": lambda c, v: c == v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Segment:
    """Immutable segment definition; every method returns a narrower segment."""

    events: DataFrame
    vocab: Vocabulary = DEFAULT_VOCABULARY
    aggregates: dict[str, Column] = field(default_factory=dict)
    predicates: tuple[Column, ...] = ()
    joins: tuple[DataFrame, ...] = ()
    texts: tuple[str, ...] = ()

    def _add(self, text: str, predicate: Column, **aggregates: Column) -> Segment:
        return replace(
            self,
            aggregates={**self.aggregates, **aggregates},
            predicates=(*self.predicates, predicate),
            texts=(*self.texts, text),
        )

    def _count(self, event_type: str) -> tuple[str, dict[str, Column]]:
        name = f"cnt_{event_type}"
        return name, {name: count_if(F.col("event_type") == event_type)}

    def did_event(self, event_type: str) -> Segment:
        n, a = self._count(event_type)
        return self._add(f"did {event_type}", F.col(n) > 0, **a)

    def did_not_event(self, event_type: str) -> Segment:
        n, a = self._count(event_type)
        return self._add(f"did not {event_type}", F.col(n) == 0, **a)

    def event_count(self, event_type: str, operator: str, value: int) -> Segment:
        """Compares a count; users without the event never match, whatever the operator."""
        if operator not in _COMPARE:
            raise ValueError(f"unknown operator: {operator}")
        n, a = self._count(event_type)
        return self._add(
            f"{event_type} {operator} {value}", (F.col(n) > 0) & _COMPARE[operator](F.col(n), value), **a
        )

    def ordered_exactly(self, n: int) -> Segment:
        return self.event_count(self.vocab.order, "eq", n)

    def ordered_at_least(self, n: int) -> Segment:
        return self.event_count(self.vocab.order, "gte", n)

    def ordered_less_than(self, n: int) -> Segment:
        """Fewer than n orders, users without orders included."""
        c, a = self._count(self.vocab.order)
        return self._add(f"orders < {n}", F.col(c) < n, **a)

    def never_ordered(self) -> Segment:
        return self.did_not_event(self.vocab.order)

    def on_platform(self, platform: str) -> Segment:
        p = platform.lower()
        name = f"on_{p}"
        return self._add(f"platform {p}", F.col(name) > 0, **{name: count_if(F.lower("platform") == p)})

    def _cutoff(self, days: float) -> Column:
        latest = self.events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()
        return latest - F.lit(int(days * US_PER_DAY))

    def active_in_last_days(self, n: float) -> Segment:
        return self._add(f"active in last {n} days", F.col("last_us") >= self._cutoff(n), last_us=F.max(micros(F.col("event_time"))))

    def inactive_for_days(self, n: float) -> Segment:
        return self._add(f"inactive for {n} days", F.col("last_us") < self._cutoff(n), last_us=F.max(micros(F.col("event_time"))))

    def first_order_between(self, start: str, end: str) -> Segment:
        """First order within the two instants, both included (a bare end date is its midnight)."""
        first = F.min(F.when(F.col("event_type") == self.vocab.order, F.col("event_time")))
        inside = F.col("first_order").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)))
        return self._add(f"first order {start}..{end}", inside, first_order=first)

    def _scored(self, text: str, users: DataFrame) -> Segment:
        return replace(self, joins=(*self.joins, users.select("user_id")), texts=(*self.texts, text))

    def with_churn_risk(self, predictions: DataFrame | None, min_probability: float = 0.7) -> Segment:
        """Users of a stored churn score at or above the bound; without scores the filter is skipped."""
        if predictions is None:
            return self
        return self._scored(f"churn >= {min_probability}", predictions.where(F.col("churn_probability") >= min_probability))

    def with_ltv_tier(self, predictions: DataFrame | None, tier: str) -> Segment:
        if predictions is None:
            return self
        return self._scored(f"ltv tier {tier}", predictions.where(F.col("ltv_tier") == tier))

    def users(self) -> DataFrame:
        if self.aggregates:
            u = self.events.groupBy("user_id").agg(*[c.alias(n) for n, c in self.aggregates.items()])
            for p in self.predicates:
                u = u.where(p)
            u = u.select("user_id")
        else:
            u = self.events.select("user_id").distinct()
        for j in self.joins:
            u = u.join(j, "user_id", "left_semi")
        return u

    def count(self) -> DataFrame:
        return self.users().agg(F.count(F.lit(1)).alias("users"))

    def describe(self) -> DataFrame:
        return self.count().withColumn("filters", F.lit(" AND ".join(self.texts) or "all users"))

    def reset(self) -> Segment:
        return Segment(self.events, self.vocab)

    def export(self, path: str | None = None) -> DataFrame:
        """User list with the filter text; written as CSV when a path is given."""
        out = self.users().withColumn("segment_filters", F.lit(" AND ".join(self.texts)))
        if path:
            out.write.mode("overwrite").option("header", True).csv(path)
        return out


def cart_abandoners(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).did_event(vocab.add).did_not_event(vocab.order)


def one_time_buyers(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).ordered_exactly(1)


def repeat_buyers(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).ordered_at_least(2)


def power_users(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).ordered_at_least(5)


def browsers_not_buyers(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).did_event(vocab.product_view).never_ordered()


def lapsed_customers(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, days: float = 30) -> Segment:
    return Segment(events, vocab).did_event(vocab.order).inactive_for_days(days)


def high_value_at_risk(
    events: DataFrame, ltv: DataFrame | None, churn: DataFrame | None, vocab: Vocabulary = DEFAULT_VOCABULARY
) -> Segment:
    return Segment(events, vocab).with_ltv_tier(ltv, "Diamond").with_churn_risk(churn, 0.6)


def engaged_non_converters(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).event_count(vocab.homepage, "gte", 3).never_ordered()


def ios_power_users(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY) -> Segment:
    return Segment(events, vocab).on_platform("ios").ordered_at_least(3)


def predefined_sizes(events: DataFrame, vocab: Vocabulary = DEFAULT_VOCABULARY, lapsed_days: float = 30) -> DataFrame:
    """Sizes of the predefined event-only segments from one profile pass."""
    t = F.col("event_type")
    u = events.groupBy("user_id").agg(
        count_if(t == vocab.order).alias("orders"),
        count_if(t == vocab.add).alias("adds"),
        count_if(t == vocab.product_view).alias("views"),
        count_if(t == vocab.homepage).alias("homes"),
        count_if(F.lower("platform") == "ios").alias("ios"),
        F.max(micros(F.col("event_time"))).alias("last_us"),
    )
    latest = events.agg(F.max(micros(F.col("event_time"))).alias("m")).scalar()
    o = F.col("orders")
    rules = {
        "cart_abandoners": (F.col("adds") > 0) & (o == 0),
        "one_time_buyers": o == 1,
        "repeat_buyers": o >= 2,
        "power_users": o >= 5,
        "browsers_not_buyers": (F.col("views") > 0) & (o == 0),
        "lapsed_customers": (o > 0) & (F.col("last_us") < latest - F.lit(int(lapsed_days * US_PER_DAY))),
        "engaged_non_converters": (F.col("homes") >= 3) & (o == 0),
        "ios_power_users": (F.col("ios") > 0) & (o >= 3),
    }
    sums = u.agg(*[count_if(c).alias(n) for n, c in rules.items()])
    return sums.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("segment"), F.coalesce(n, F.lit(0)).alias("users")) for n in rules])).alias("s")
    ).select("s.*")
