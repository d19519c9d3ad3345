"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are partitioned by their number of words.  In the partition of items up to u words, documents are looked at through windows
of 2u words, u apart, so that any passage of u words lies in one window and the two sets compared are of similar size whatever the
document's length.  A containment of t then means a Jaccard similarity of at least s, and as many MinHash values are taken as make all of
them miss with a chance below ``MISS``.  Windows whose value is an item's are candidates; these are verified on whole documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import bits_set, in_table, membership, pieces, saved
from tidelens.llm.words import U64, distinct, hashes, mix, shingles, tokens

CONTAINED, SIZE, MISS, GROWTH = 0.75, 5, 1e-4, 1.5
#: Words of the first partition's longest items; its shortest have one shingle.
FIRST = 8
#: Between words: all of ASCII but letters and digits.
SEPARATORS = np.array([not (chr(b).isalnum() and b < 128) and b < 128 for b in range(256)])


def bounds(most: int) -> list[int]:
    """Upper word counts of the partitions, up to one that holds ``most``."""
    out = [FIRST]
    while out[-1] < most:
        out.append(math.ceil(out[-1] * GROWTH))
    return out


def values_needed(upper: int, contained: float, miss: float = MISS) -> int:
    """MinHash values of a partition: (1 - s)**k <= miss for its shortest items."""
    fewest = 1 if upper == FIRST else max(1, math.floor(upper / GROWTH) + 1 - (SIZE - 1))
    s = contained * fewest / (2 * upper + fewest - contained * fewest)
    return math.ceil(math.log(miss) / math.log(1 - s))


def word_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, starts, lengths, text = tokens(texts, SEPARATORS)
    return shingles(hashes(buf, starts, lengths), text, len(texts), SIZE)


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


def _key(value: np.ndarray, upper: int, k: int) -> np.ndarray:
    return mix(value + U64((upper * 4099 + k) * 0x9E3779B97F4A7C15 % (1 << 64)))


def blocks(owner: np.ndarray, upper: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where blocks of ``upper`` shingles begin in each text, the blocks' text numbers, and which are followed by one of the same text."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.r_[starts, len(owner)]))
    block = np.flatnonzero(place % upper == 0)
    who = owner[block]
    return block, who, np.flatnonzero(who[1:] == who[:-1])


def minima(values: np.ndarray, block: np.ndarray, followed: np.ndarray) -> np.ndarray:
    """The least value of every window: a block and the one after it."""
    v = np.minimum.reduceat(values, block)
    v[followed] = np.minimum(v[followed], v[followed + 1])
    return v


def contaminated(
    docs: DataFrame, items: DataFrame, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item (shingles) and containment of every pair in which the document holds that share of the item.

    Words are runs of letters and digits in lower case, shingles have five; an item of fewer words is one shingle as a whole, which only a
    document of just these words holds.  Rows without id, text or words pair with nothing.  Repeated rows: an id's pair comes once, with its
    largest containment.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), F.lower(docs[text_col].cast("string")).alias("text")).where("doc_id is not null and text is not null")
    tests = items.select(items[item_col].cast("long").alias("item_id"), F.lower(items[item_text_col].cast("string")).alias("text")).where("item_id is not null and text is not null")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's partition, shingles and keys."""
        for texts, rows in pieces(batches):
            v, owner = distinct(*word_shingles(texts))
            n = np.bincount(owner, minlength=len(texts))
            cuts = np.r_[0, np.cumsum(n)]
            ids, uppers, blobs, keys = [], [], [], []
            for i, item in enumerate(rows.column(0).to_pylist()):
                if not n[i]:
                    continue
                mine = v[cuts[i] : cuts[i + 1]]
                upper = bounds(len(mine) + SIZE - 1)[-1]
                ids.append(item)
                uppers.append(upper)
                blobs.append(mine.tobytes())
                needed = values_needed(upper, contained)
                keys.append([int(_key(np.array([(mine * f).min()]), upper, k).view(np.int64)[0]) for k, f in enumerate(_factors(needed))])
            columns = [pa.array(ids, pa.int64()), pa.array(uppers, pa.int32()), pa.array(blobs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["item_id", "upper", "shingles", "keys"])

    known = saved(tests.mapInArrow(described, "item_id long, upper int, shingles binary, keys array<long>"), "items")
    uppers = sorted(r["upper"] for r in known.select("upper").distinct().collect())
    keys = known.select(F.explode("keys").alias("key"), "item_id")
    table = spark.sparkContext.broadcast(membership(keys.select("key"), hashed=True))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            runs, owner = word_shingles(texts)
            order = np.argsort(owner, kind="stable")  # texts of one short shingle come last
            runs, owner = runs[order], owner[order]
            ids = rows.column(0).to_numpy()
            found, who = [np.empty(0, U64)], [np.empty(0, np.int64)]
            laid = {upper: blocks(owner, upper) for upper in uppers} if len(runs) else {}
            for k, factor in enumerate(_factors(max((values_needed(u, contained) for u in laid), default=0))):
                values = runs * factor
                for upper, (block, text, followed) in laid.items():
                    if k < values_needed(upper, contained):
                        v = _key(minima(values, block, followed), upper, k)
                        hit = bits_set(table.value, v)
                        found.append(v[hit])
                        who.append(text[hit])
            columns = [np.concatenate(found).view(np.int64), ids[np.concatenate(who)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id"])

    pairs = named.mapInArrow(windows, "key long, doc_id long").distinct().join(keys, "key").select("doc_id", "item_id").distinct()
    pairs = saved(pairs, "candidates")
    asked = pairs.join(known.select("item_id", "shingles"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "shingles")).alias("asked"))
    table2 = spark.sparkContext.broadcast(membership(pairs.select("doc_id").distinct()))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            v, owner = distinct(*word_shingles(texts))
            cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
            out = []
            for i, (doc, asked_) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                mine = v[cuts[i] : cuts[i + 1]]
                for a in asked_:
                    item = np.frombuffer(a["shingles"], U64)
                    shared = int((mine[np.minimum(np.searchsorted(mine, item), len(mine) - 1)] == item).sum()) if len(mine) else 0
                    if shared >= contained * len(item):
                        out.append((doc, a["item_id"], shared, len(item), shared / len(item)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_shared", "n_item", "containment"])

    chosen = named.where(in_table(table2, F.xxhash64("doc_id"))).join(asked, "doc_id").select("doc_id", "text", "asked")
    done = chosen.mapInArrow(verified, "doc_id long, item_id long, n_shared long, n_item long, containment double")
    return done.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_shared", "n_item", "containment")))
