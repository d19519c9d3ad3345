"""How filters interact: what each removes, in every order, from relations of failing ids.

Each filter is a table of the ids that fail it.  A left-anti join with that table leaves the survivors of one more filter, a left-semi join
finds whom it removes.  What survives a prefix of an order depends on the set of its filters only, so survivors are kept once for each set
(bit i: filter i), level by level: the rows of a level are joined with each filter's ids, all sets at a time.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import folder, saved

WORDS = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_filters(text: Column, words: Column) -> dict[str, Column]:
    """Failure conditions on one document's text and words, by name."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def documents_and_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(key, part) of every document with an id, and one stored table of failing keys for each of the filters A-E.

    A key is (id, hash of the text), as rows of one id may differ.  Null texts are empty, null parts an empty string.  E fails where the same
    text belongs to a smaller id: texts are compared by their SHA-256 over the whole table, so a group of copies of any size is one row of
    partial sums, and only ids and digests are shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    conditions = text_filters(F.col("text"), F.col("words"))
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORDS), 0))
    facts = saved(rows.select("id", F.xxhash64("text").alias("version"), "part", F.unhex(F.sha2("text", 256)).alias("digest"), failed.alias("failed")), "audit-documents")
    first = facts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = facts.select("id", "version", "digest").join(first.select("digest", "first"), "digest").where("id > first")
    path = folder(spark, "audit-failures")
    failures = facts.select(F.explode("failed").alias("filter"), "id", "version").unionByName(copies.select(F.lit("E").alias("filter"), "id", "version"))
    failures.write.partitionBy("filter").parquet(path)
    stored = spark.read.schema("id long, version long, filter string").parquet(path)
    return facts.select("id", "version", "part"), {name: stored.where(F.col("filter") == name).select("id", "version") for name in [*conditions, "E"]}


def interactions(rows: DataFrame, failures: dict[str, DataFrame], keys: list[str], labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(part, set, filter, n and a sum of each label) of the rows that each filter removes from each set's survivors, and (part, set, kept).

    ``rows`` has the keys, `part` and the 0/1 labels.  Combinations without rows are left out.
    """
    names = list(failures)
    removed, kept = [], []
    level = rows.select(*keys, "part", *labels, F.lit(0).alias("set"))
    for k in range(len(names) + 1):
        level = saved(level, f"audit-survivors-{k}")
        kept.append(level.groupBy("part", "set").agg(F.count(F.lit(1)).alias("kept")))
        # survivors of a set hold no id that its own filters fail, so every set of the level can meet every filter
        met = [level.join(ids, keys, "left_semi").groupBy("part", "set").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in labels]).withColumn("filter", F.lit(name)) for name, ids in failures.items()]
        if k == len(names):
            break
        removed += [saved(_union(met), f"audit-removed-{k}")]
        # each set comes from the one without its last filter
        level = _union([level.where(F.col("set") < 1 << i).join(failures[name], keys, "left_anti").withColumn("set", F.col("set") + F.lit(1 << i)) for i, name in enumerate(names)])
    return _union(removed), _union(kept)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", label_id: str = "doc_id") -> DataFrame:
    """One row per part, order of the filters A-E and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Rows without an id take no part; several rows of one id count one by one.  Labels of one id: it is good if any has quality 1, toxic if
    any has toxic 1; documents without a label, or with a null one, are neither.  An empty table has no parts, so no rows.
    """
    facts, failures = documents_and_failures(docs, id_col, text_col, part_col)
    marks = labels.where(labels[label_id].isNotNull()).groupBy(labels[label_id].cast("long").alias("id")).agg(
        F.max(F.when(labels["quality"] == 1, 1).otherwise(0)).alias("good"), F.max(F.when(labels["toxic"] == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = facts.join(marks, "id", "left").select("id", "version", "part", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    removed, kept = interactions(rows, failures, ["id", "version"], ["good", "toxic"])
    return every_order(removed, kept, list(failures))


def every_order(removed: DataFrame, kept: DataFrame, names: list[str]) -> DataFrame:
    """The sets' figures laid out along all orders of the filters, zeros included.

    The number of orders depends on the filters only.  A filter's removals summed over all orders weigh each set by the orders in which it is
    the prefix: |set|! times the factorial of the filters that follow.
    """
    spark = removed.sparkSession
    n, full = len(names), (1 << len(names)) - 1
    bit = {name: 1 << i for i, name in enumerate(names)}
    steps = []
    for order in permutations(sorted(names)):
        before = 0
        for step, name in enumerate(order, 1):
            steps.append(("".join(order), step, name, before))
            before |= bit[name]
    cells = [F.struct(F.lit(s).alias("set"), F.lit(name).alias("filter"), F.lit(s | b).alias("after"), F.lit(factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())).cast("long").alias("weight")) for s in range(full + 1) for name, b in bit.items() if not s & b]
    grid = kept.where("set = 0").select("part", F.explode(F.array(*cells)).alias("c")).select("part", "c.*")
    left = kept.select("part", F.col("set").alias("after"), "kept")
    found = grid.join(removed, ["part", "set", "filter"], "left").join(left, ["part", "after"], "left").na.fill(0, ["n", "good", "toxic", "kept"])
    own = Window.partitionBy("part", "filter")
    alone = F.when(F.col("after") == full, F.col("n"))
    figures = found.select(
        "part",
        "set",
        "filter",
        "kept",
        F.col("n").alias("removed"),
        (F.max(F.when(F.col("set") == 0, F.col("n"))).over(own) - F.col("n")).alias("redundant"),
        F.max(alone).over(own).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum(F.col("n") * F.col("weight")).over(own).alias("shapley"),
    )
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, set int")
    return figures.join(F.broadcast(orders), ["set", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
