"""tidelens: product analytics over event tables, expressed as Spark DataFrame queries."""

from tidelens.schema import DEFAULT_VOCABULARY, EventSchema, Vocabulary

__all__ = ["DEFAULT_VOCABULARY", "EventSchema", "Vocabulary"]
