"""Merchant recommendation: interactions, popularity, item-item cosine, scores for all users.

Everything is in long form.  ``interactions`` is (user, merchant, cnt); a similarity frame is
(merchant, other, similarity) in both directions and holds non-zero pairs only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.functions.columns import ratio
from tidelens.functions.distributed import ordinal_ranks, pair_sums, top_per_group, total_of
from tidelens.functions.tables import new_path, stored

#: Copies of each popularity rank, so that no task answers all users; slack of compared cosines for the order of addition.
RANK_SALTS = 32
MARGIN = 1e-9
#: Similarities, and merchants of histories and lists, that a task of :func:`recommend` holds.
SIMILARITY_BLOCK = 2_000_000
HISTORY_BLOCK = 4_000_000
#: Cells for each similarity up to which a block becomes a matrix.
DENSE = 4


def interactions(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("merchant").isNotNull()).groupBy("user_id", "merchant").agg(F.count(F.lit(1)).alias("cnt"))


def popularity(inter: DataFrame) -> DataFrame:
    """Share of all orders per merchant."""
    g = inter.groupBy("merchant").agg(F.sum("cnt").alias("orders"))
    return g.withColumn("score", ratio(F.col("orders"), total_of(inter, "cnt")))


def recommend_popular(inter: DataFrame, n: int = 10, exclude_ordered: bool = True, table: bool = False) -> DataFrame:
    """Most popular merchants per user, without those already ordered.

    A user with h merchants in the history needs at most the n+h most popular ones: their ranks without those of the history are taken
    in an array, and only the n that stay become rows, so work grows with users and history, not with users times merchants.  Every
    user asks for the first ranks, so ranks are salted by the user.  ``table``: ``inter`` is a stored table, which is not written again.
    """
    inter = inter if table else stored(inter, "interactions")
    pop = popularity(inter)
    ranked = stored(ordinal_ranks(pop, [F.desc("orders"), F.asc("merchant")], "pop_rank").select("merchant", "score", "pop_rank"), "popularity")
    if exclude_ordered:
        # rows without a user are no one's history
        known = inter.join(ranked.select("merchant", F.col("pop_rank").alias("own")), "merchant", "left")
        own = F.collect_list(F.when(F.col("user_id").isNotNull(), F.col("own")))
        hist = known.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"), own.alias("own"))
        left = F.slice(F.array_except(F.sequence(F.lit(1).cast("long"), F.col("h") + F.lit(n)), "own"), 1, n)
    else:
        hist, left = inter.select("user_id").distinct(), F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))
    salt = F.pmod(F.xxhash64("user_id"), F.lit(RANK_SALTS)).cast("int")
    wanted = hist.select("user_id", salt.alias("salt"), F.posexplode(left).alias("at", "pop_rank"))
    every = F.explode(F.sequence(F.lit(0), F.lit(RANK_SALTS - 1))).alias("salt")
    cand = wanted.join(ranked.select("merchant", "score", "pop_rank", every), ["pop_rank", "salt"])
    return cand.select("user_id", "merchant", "score", (F.col("at") + 1).alias("rank"))


def _supported(inter: DataFrame, min_support: int) -> DataFrame:
    if min_support <= 0:
        return inter
    ok = inter.groupBy("merchant").agg(F.sum("cnt").alias("n")).where(F.col("n") >= min_support).select("merchant")
    return inter.join(ok, "merchant", "left_semi")


def _unit_vectors(inter: DataFrame) -> DataFrame:
    """``user_id, merchant, cnt, w``: counts over the norm of their merchant."""
    norms = inter.groupBy("merchant").agg(F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt"))).alias("norm"))
    return inter.join(norms, "merchant").select("user_id", "merchant", "cnt", (F.col("cnt") / F.col("norm")).alias("w"))


def _cosines(dots: DataFrame, inter: DataFrame) -> DataFrame:
    """``a, b, similarity`` of dot products: sums of whole numbers, so they do not depend on the order of addition."""
    # written, as its size is then known before the pairs are dealt out for a join
    norms = stored(inter.groupBy("merchant").agg(F.sqrt(F.sum(F.col("cnt").cast("double") * F.col("cnt"))).alias("norm")), "norms")
    return (
        dots.join(norms.select(F.col("merchant").alias("a"), F.col("norm").alias("na")), "a")
        .join(norms.select(F.col("merchant").alias("b"), F.col("norm").alias("nb")), "b")
        .select("a", "b", (F.col("total") / (F.col("na") * F.col("nb"))).alias("similarity"))
    )


def _both_ways(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) as (merchant, other, similarity) in both directions, from one evaluation."""
    way = F.array(
        F.struct(F.col("a").alias("merchant"), F.col("b").alias("other")), F.struct(F.col("b").alias("merchant"), F.col("a").alias("other"))
    )
    return pairs.select(F.explode(way).alias("p"), "similarity").select("p.merchant", "p.other", "similarity")


def item_similarity(inter: DataFrame, min_support: int = 0, n_neighbors: int | None = None, min_similarity: float | None = None, table: bool = False) -> DataFrame:
    """Cosine of the merchants' count vectors over users.

    ``min_support`` drops merchants with fewer orders, ``n_neighbors`` keeps the closest ones, ``min_similarity`` the pairs that reach it
    (to nine digits), found without forming all pairs; all are off by default and change the result when used.  ``table``: ``inter`` is
    a stored table, which is not written again.
    """
    src = inter if table and min_support <= 0 else stored(_supported(inter, min_support), "interactions")
    if min_similarity is not None and min_similarity > 0:
        pairs = similar_pairs(src, min_similarity)
    else:
        pairs = _cosines(pair_sums(src, "user_id", "merchant", "cnt"), src)
    both = _both_ways(pairs)
    if n_neighbors:
        both = top_per_group(both, ["merchant"], [F.desc("similarity"), F.asc("other")], n_neighbors).drop("rank")
    return both


def indexed_part(inter: DataFrame, least: float) -> DataFrame:
    """``user_id, merchant, cnt, w, bound``: the part of each merchant's unit vector that any pair of cosine ``least`` must share.

    Users are put into classes by the number of their merchants, those with most first.  The dot product over the leading classes of a
    vector is at most the norm of that part, and at most its sum against each user's largest weight.  While the smaller of both stays
    below ``least``, a pair needs more than these classes, so they are left out, and with them the users who form most pairs.
    ``bound`` is what the part left out can still add.
    """
    v = _unit_vectors(inter)
    users = v.groupBy("user_id").agg(F.count(F.lit(1)).alias("_m"), F.max("w").alias("_top"))
    classed = v.join(users, "user_id").withColumn("_class", -F.floor(F.log2("_m")))
    sums = classed.groupBy("merchant", "_class").agg(F.sum(F.col("w") * F.col("w")).alias("_square"), F.sum(F.col("w") * F.col("_top")).alias("_reach"))
    upto = Window.partitionBy("merchant").orderBy("_class").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a class
    reach = F.least(F.sqrt(F.sum("_square").over(upto)), F.sum("_reach").over(upto))
    classes = sums.select("merchant", "_class", reach.alias("_upto")).withColumn("_left", F.col("_upto") < F.lit(least - MARGIN))
    bounds = Window.partitionBy("merchant")
    marked = classes.select("merchant", "_class", "_left", F.coalesce(F.max(F.when(F.col("_left"), F.col("_upto"))).over(bounds), F.lit(0.0)).alias("bound"))
    return classed.join(marked.where("not _left"), ["merchant", "_class"]).select("user_id", "merchant", "cnt", "w", "bound")


def similar_pairs(inter: DataFrame, least: float) -> DataFrame:
    """``a, b, similarity`` of every pair of merchants whose cosine is at least ``least``: exact, and without forming most others.

    Pairs are formed over the indexed parts only; those whose partial dot product and bounds can still reach ``least`` get their whole one.
    """
    part = stored(indexed_part(inter, least), "indexed-part")
    bounds = part.groupBy("merchant").agg(F.max("bound").alias("bound"))
    sums = (
        pair_sums(part, "user_id", "merchant", "w")
        .join(bounds.select(F.col("merchant").alias("a"), F.col("bound").alias("_ba")), "a")
        .join(bounds.select(F.col("merchant").alias("b"), F.col("bound").alias("_bb")), "b")
    )
    # the dot product over the longer of the parts left out is within that merchant's bound, and so within the larger bound
    maybe = stored(sums.where(F.col("total") + F.greatest("_ba", "_bb") >= F.lit(least - MARGIN)).select("a", "b"), "similar-pairs")
    named = maybe.select(F.explode(F.array("a", "b")).alias("merchant")).distinct()
    whole = inter.select("user_id", "merchant", "cnt").join(named, "merchant", "left_semi")
    dots = pair_sums(whole, "user_id", "merchant", "cnt").join(maybe, ["a", "b"], "left_semi")
    return _cosines(dots, inter).where(F.round("similarity", 9) >= F.lit(least))


class ItemItemRecommender:
    """A fitted recommender as two tables, interactions and similarities, that can be saved, loaded and read by other reports."""

    def __init__(self, inter: DataFrame, similarity: DataFrame):
        self.inter, self.similarity = inter, similarity

    @staticmethod
    def fit(inter: DataFrame, path: str | None = None, **options) -> ItemItemRecommender:
        """Evaluated once and written to ``path`` (or to the shared folder); ``options`` are those of :func:`item_similarity`."""
        spark = inter.sparkSession
        path = path or new_path(spark, "recommender")
        inter = stored(inter, "", f"{path}/interactions")
        stored(item_similarity(inter, table=True, **options), "", f"{path}/similarity")
        return ItemItemRecommender.load(spark, path)

    def save(self, path: str) -> None:
        self.inter.write.mode("overwrite").parquet(f"{path}/interactions")
        self.similarity.write.mode("overwrite").parquet(f"{path}/similarity")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ItemItemRecommender:
        return ItemItemRecommender(spark.read.parquet(f"{path}/interactions"), spark.read.parquet(f"{path}/similarity"))

    def recommend(self, n: int = 10, exclude_ordered: bool = True) -> DataFrame:
        return recommend(self.inter, self.similarity, n, exclude_ordered)

    def similar_merchants(self, merchant: str, n: int = 10) -> DataFrame:
        return similar_merchants(self.similarity, merchant, n)

    def explain(self, user_id: int, merchant: str, n: int = 5) -> DataFrame:
        return explain(self.inter, self.similarity, user_id, merchant, n)

    def stats(self) -> DataFrame:
        return stats(self.inter)


def score_all(inter: DataFrame, similarity: DataFrame) -> DataFrame:
    """Score of every reachable merchant per user: mean over the history of similarity times ln(1+count)."""
    sizes = inter.groupBy("user_id").agg(F.count(F.lit(1)).alias("h"))
    raw = (
        inter.join(similarity, "merchant")
        .groupBy("user_id", "other")
        .agg(F.sum(F.col("similarity") * F.log1p("cnt")).alias("s"))
    )
    return raw.join(sizes, "user_id").select("user_id", F.col("other").alias("merchant"), (F.col("s") / F.col("h")).alias("score"))


def _best_of_block(n: int, exclude_ordered: bool):
    """Arrow function of one group: users' histories against one block of similarities, each user's ``n`` best of the block and ties, packed.

    Similarities that fill a good part of their rows and columns are a matrix, whose rows are weighted and summed at once.
    """

    def best(users: pa.Table, near: pa.Table) -> pa.Table:
        none = pa.table({"user_id": users["user_id"].slice(0, 0), "_os": pa.array([], pa.list_(pa.int32())), "_scores": pa.array([], pa.list_(pa.float64()))})
        if not users.num_rows or not near.num_rows:
            return none
        m, sim = near["_m"].to_numpy(), near["similarity"].to_numpy()
        others, column = np.unique(near["_o"].to_numpy(), return_inverse=True)
        order = np.argsort(m, kind="stable")
        column, sim = column[order].astype(np.int32), sim[order]
        known, start = np.unique(m[order], return_index=True)
        end = np.append(start[1:], len(m))
        square = None
        if len(known) * len(others) <= DENSE * len(m):
            square = np.zeros((len(known), len(others)))
            np.add.at(square, (np.repeat(np.arange(len(known)), end - start), column), sim)
        histories = users["_h"].combine_chunks()
        history, at = histories.flatten(), histories.offsets.to_numpy() - histories.offsets[0].as_py()
        merchant, weight = history.field("_m").to_numpy(zero_copy_only=False), history.field("_w").to_numpy(zero_copy_only=False)
        row = np.minimum(np.searchsorted(known, merchant), len(known) - 1)
        row = np.where(known[row] == merchant, row, -1)
        place = np.minimum(np.searchsorted(others, merchant), len(others) - 1)
        place = np.where(others[place] == merchant, place, -1)
        size = users["_size"].to_numpy()
        what, score = [], []
        for u in range(len(at) - 1):
            total = np.zeros(len(others))
            mine = slice(at[u], at[u + 1])
            if square is not None:
                met = row[mine] >= 0
                total = weight[mine][met] @ square[row[mine][met]] / size[u]
            elif rows := [(start[row[i]], end[row[i]], weight[i]) for i in range(at[u], at[u + 1]) if row[i] >= 0]:
                added = np.concatenate([sim[a:b] * w for a, b, w in rows])
                total = np.bincount(np.concatenate([column[a:b] for a, b, _ in rows]), added, len(others)) / size[u]
            if exclude_ordered:
                ordered = place[mine]
                total[ordered[ordered >= 0]] = 0
            found = np.flatnonzero(total > 0)
            if len(found) > n:
                # lists are ordered by nine digits, then by name: all that could tie with the last one stay
                last = np.partition(total[found], len(found) - n)[len(found) - n]
                found = found[total[found] >= last - 2e-9]
            what.append(others[found])
            score.append(total[found])
        cuts = np.cumsum([0, *map(len, what)])
        ids = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(what), pa.int32()))
        scores = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(score), pa.float64()))
        return pa.table({"user_id": users["user_id"], "_os": ids, "_scores": scores})

    return best


def recommend(
    inter: DataFrame, similarity: DataFrame, n: int = 10, exclude_ordered: bool = True, block: int = SIMILARITY_BLOCK, least_blocks: int = 1, tasks: int = 6
) -> DataFrame:
    """Top-n merchants per user with positive score: ``user_id, merchant, score, rank``.

    Scores are those of :func:`score_all`, and none of them travels that cannot be in a list.  Similarities are dealt into blocks of
    recommended merchants, of about ``block`` rows; each block meets the histories of the users who know a merchant near one of
    it, a task forms their scores in an array and hands on the n best as one packed list.  There are no more blocks than similarities
    fill, as every block answers each of its users with a list.  Merchants with the same smallest neighbour share a block where
    there is room, so that where customers keep to clusters of merchants a history travels to few blocks.
    """
    inter = inter.where("user_id is not null")
    # a merchant that is in no history and no one's neighbour has no part in a list
    names = inter.select("merchant").union(similarity.select("other")).where("merchant is not null").distinct()
    ids = stored(ordinal_ranks(names, [F.asc("merchant")], "_id").select("merchant", F.col("_id").cast("int").alias("_id")), "merchants")
    near = (
        similarity.where("similarity is not null")
        .join(ids.select("merchant", F.col("_id").alias("_m")), "merchant")
        .join(ids.select(F.col("merchant").alias("other"), F.col("_id").alias("_o")), "other")
        .select("_m", "_o", F.col("similarity").cast("double").alias("similarity"))
    )
    near = stored(near, "near")
    total = near.count()
    blocks = max(least_blocks, math.ceil(total / block))
    known = F.when(F.col("_id").isNotNull(), F.struct(F.col("_id").alias("_m"), F.log1p("cnt").alias("_w")))
    history, size = F.collect_list(known).alias("_h"), F.count(F.lit(1)).alias("_size")
    histories = inter.join(ids, "merchant", "left")
    # tables of merchants and of blocks are written: their sizes are then known, and what joins them need not be dealt out first
    if blocks == 1:  # every history meets the only block
        near = near.withColumn("_b", F.lit(0))
        users = histories.groupBy("user_id").agg(history, size).where(F.size("_h") > 0).withColumn("_b", F.lit(0))
    else:
        reach = near.groupBy("_o").agg(F.least(F.min("_m"), F.col("_o")).alias("_label"), F.count(F.lit(1)).alias("_n"))
        reach = stored(reach, "reach")
        sizes = reach.groupBy("_label").agg(F.ceil(F.sum("_n") / F.lit(max(1, math.ceil(total / blocks)))).alias("_cut"))
        place = F.pmod(F.xxhash64("_label"), F.lit(blocks)) + F.pmod(F.xxhash64("_o"), F.col("_cut"))
        dealt = stored(reach.join(sizes, "_label").select("_o", F.pmod(place, F.lit(blocks)).cast("int").alias("_b")), "blocks")
        near = near.join(dealt, "_o")
        touched = stored(near.groupBy("_m").agg(F.collect_set("_b").alias("_bs")), "touched")
        reached = histories.join(touched, F.col("_id") == F.col("_m"), "left").groupBy("user_id")
        users = reached.agg(history, F.array_distinct(F.flatten(F.collect_list("_bs"))).alias("_bs"), size)
        users = users.select("user_id", "_h", "_size", F.explode("_bs").alias("_b"))
    users = stored(users.select("user_id", "_h", "_size", "_b"), "histories")
    load = users.groupBy("_b").agg(F.sum(F.size("_h") + F.lit(n)).alias("_load"))
    parts = F.greatest(F.ceil(F.col("_load") / F.lit(max(block, HISTORY_BLOCK))), F.lit(math.ceil(tasks / blocks))).cast("int").alias("_parts")
    parts = stored(load.select("_b", parts), "parts")
    users = users.join(parts, "_b").withColumn("_part", F.pmod(F.xxhash64("user_id"), F.col("_parts")).cast("int")).drop("_parts")
    near = near.join(parts, "_b").select("_m", "_o", "similarity", "_b", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    schema = T.StructType([inter.schema["user_id"], T.StructField("_os", T.ArrayType(T.IntegerType())), T.StructField("_scores", T.ArrayType(T.DoubleType()))])
    best = users.groupBy("_b", "_part").cogroup(near.groupBy("_b", "_part")).applyInArrow(_best_of_block(n, exclude_ordered), schema)
    if blocks == 1:
        # a task has all of a user's scores, so its list is sorted where it is
        order = lambda x: F.struct((-F.round(x["_scores"], 9)).alias("_down"), x["_os"].alias("_o"), x["_scores"].alias("score"))
        first = F.slice(F.sort_array(F.transform(F.arrays_zip("_os", "_scores"), order)), 1, n)
        ranked = best.select("user_id", F.posexplode(first).alias("_at", "_x"))
        ranked = ranked.select("user_id", F.col("_x._o").alias("_o"), F.col("_x.score").alias("score"), (F.col("_at") + 1).alias("rank"))
    else:
        # lists travel packed, dealt by user as the ranking needs them
        met = best.repartition("user_id").select("user_id", F.explode(F.arrays_zip("_os", "_scores")).alias("_x"))
        met = met.select("user_id", F.col("_x._os").alias("_o"), F.col("_x._scores").alias("score"))
        ranked = top_per_group(met, ["user_id"], [F.desc(F.round("score", 9)), F.asc("_o")], n)
    return ranked.join(ids, F.col("_o") == F.col("_id")).select("user_id", "merchant", "score", "rank")


def similar_merchants(similarity: DataFrame, merchant: str, n: int = 10) -> DataFrame:
    return (
        similarity.where((F.col("merchant") == merchant) & (F.col("similarity") > 0))
        .orderBy(F.desc(F.round("similarity", 9)), "other")
        .limit(n)
        .select(F.col("other").alias("merchant"), "similarity")
    )


def explain(inter: DataFrame, similarity: DataFrame, user_id: int, merchant: str, n: int = 5) -> DataFrame:
    """The user's history merchants closest to the recommended one."""
    h = inter.where(F.col("user_id") == user_id).select("merchant", "cnt")
    s = similarity.where((F.col("other") == merchant) & (F.col("similarity") > 0)).select("merchant", "similarity")
    return h.join(s, "merchant").orderBy(F.desc(F.round("similarity", 9)), "merchant").limit(n).select(
        "merchant", "similarity", F.col("cnt").alias("order_count")
    )


def stats(inter: DataFrame) -> DataFrame:
    users = inter.agg(F.countDistinct("user_id").alias("n")).scalar()
    merchants = inter.agg(F.countDistinct("merchant").alias("n")).scalar()
    g = inter.agg(F.count(F.lit(1)).alias("nnz"), F.sum("cnt").alias("orders")).select(
        "nnz", "orders", users.alias("n_users"), merchants.alias("n_merchants")
    )
    u, m = F.col("n_users").cast("double"), F.col("n_merchants")
    return g.select(
        "n_users",
        "n_merchants",
        ratio(F.col("nnz"), u * m).alias("matrix_density"),
        ratio(F.col("orders"), F.col("n_users")).alias("avg_orders_per_user"),
        ratio(F.col("orders"), F.col("n_merchants")).alias("avg_users_per_merchant"),
    )


def user_history(inter: DataFrame, user_id: int, n: int = 10) -> DataFrame:
    return (
        inter.where(F.col("user_id") == user_id)
        .orderBy(F.desc("cnt"), "merchant")
        .limit(n)
        .select("merchant", F.col("cnt").alias("orders"))
    )


def merchant_usage(inter: DataFrame, merchant: str) -> DataFrame:
    return inter.where(F.col("merchant") == merchant).agg(
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("orders"), F.count(F.lit(1)).alias("customers")
    )
