"""Event schema: which source columns feed the canonical frame, and what the event names mean.

Operators never see source column names.  They read the canonical events frame

    user_id, event_time, event_type, platform, event_id [, event_properties, optional columns]

and take a :class:`Vocabulary` that says which event types play which role.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Event names, funnels and roles of the canonical vocabulary.
FUNNEL_7 = (
    "homepage_viewed",
    "product_page_viewed",
    "product_added",
    "cart_page_viewed",
    "checkout_button_pressed",
    "payment_initiated",
    "checkout_completed",
)
FUNNEL_9 = (
    "homepage_viewed",
    "category_page_viewed",
    "merchant_page_viewed",
    "product_page_viewed",
    "product_added",
    "cart_page_viewed",
    "checkout_button_pressed",
    "payment_initiated",
    "checkout_completed",
)
JOURNEY_STAGES = FUNNEL_9 + ("order_delivered",)
SCORING_STAGES = (
    "homepage_viewed",
    "product_page_viewed",
    "product_added",
    "cart_page_viewed",
    "checkout_button_pressed",
    "checkout_completed",
)
CONVERSION_STAGES = (
    "homepage_viewed",
    "product_page_viewed",
    "product_added",
    "cart_page_viewed",
    "checkout_button_pressed",
    "checkout_completed",
)
TOUCHPOINTS = (
    "homepage_viewed",
    "category_page_viewed",
    "search_made",
    "merchant_page_viewed",
    "product_page_viewed",
    "product_added",
    "cart_created",
    "cart_page_viewed",
    "checkout_button_pressed",
    "payment_initiated",
)
POST_CONVERSION = (
    "checkout_completed",
    "order_delivered",
    "checkout_button_pressed",
    "payment_initiated",
    "order_info_page_viewed",
)
PLATFORMS = ("android", "ios", "web")
REQUIRED_COLUMNS = ("amplitude_id", "event_type", "event_time", "platform")
OPTIONAL_COLUMNS = ("device_family", "os_name", "os_version", "country", "device_id")


@dataclass(frozen=True)
class Vocabulary:
    """Event types by role.  Override fields to run the same operators on another event set."""

    homepage: str = "homepage_viewed"
    category_view: str = "category_page_viewed"
    merchant_view: str = "merchant_page_viewed"
    product_view: str = "product_page_viewed"
    search: str = "search_made"
    add: str = "product_added"
    cart_created: str = "cart_created"
    cart: str = "cart_page_viewed"
    checkout_button: str = "checkout_button_pressed"
    payment: str = "payment_initiated"
    payment_method_view: str = "change_payment_method_viewed"
    order: str = "checkout_completed"
    delivered: str = "order_delivered"
    funnel: tuple[str, ...] = FUNNEL_7
    full_funnel: tuple[str, ...] = FUNNEL_9
    journey_stages: tuple[str, ...] = JOURNEY_STAGES
    scoring_stages: tuple[str, ...] = SCORING_STAGES
    conversion_stages: tuple[str, ...] = CONVERSION_STAGES
    touchpoints: tuple[str, ...] = TOUCHPOINTS
    post_conversion: tuple[str, ...] = POST_CONVERSION
    order_events: tuple[str, ...] = ("checkout_completed", "order_delivered")
    platforms: tuple[str, ...] = PLATFORMS
    event_types: tuple[str, ...] = field(
        default=(
            "homepage_viewed",
            "category_page_viewed",
            "merchant_page_viewed",
            "product_page_viewed",
            "search_made",
            "product_added",
            "cart_created",
            "cart_page_viewed",
            "checkout_button_pressed",
            "payment_initiated",
            "change_payment_method_viewed",
            "checkout_completed",
            "order_delivered",
            "user_signed_up",
            "phone_entered",
            "otp_entered",
            "order_info_page_viewed",
        )
    )


DEFAULT_VOCABULARY = Vocabulary()


@dataclass(frozen=True)
class EventSchema:
    """Maps source columns to the canonical events frame."""

    user: str = "amplitude_id"
    time: str = "event_time"
    event_type: str = "event_type"
    platform: str = "platform"
    properties: str = "event_properties"
    event_id: str | None = None
    required: tuple[str, ...] = REQUIRED_COLUMNS
    optional: tuple[str, ...] = OPTIONAL_COLUMNS
    vocabulary: Vocabulary = DEFAULT_VOCABULARY


EVENTS_STRUCT = T.StructType(
    [
        T.StructField("amplitude_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("platform", T.StringType()),
        T.StructField("device_family", T.StringType()),
        T.StructField("os_name", T.StringType()),
        T.StructField("os_version", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("device_id", T.StringType()),
        T.StructField("event_properties", T.StringType()),
    ]
)
