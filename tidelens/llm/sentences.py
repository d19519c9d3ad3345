"""Substring dedup by sliding sentence spans: runs of consecutive sentences that occur before elsewhere take their sentences away.

A sentence ends with a word that ends in `.`, `!` or `?`, or at a line break.  From every sentence goes one run: the next ``SENTENCES`` or
more that hold ``WORDS`` words (a single sentence does from ``ALONE`` words on).  With ``ends``, one run also leads to every sentence: the
``SENTENCES`` or more up to it that hold ``WORDS`` words.  Both together cover every sentence of every longer run that is repeated sentence
by sentence.  Runs are hashed by their words in lower case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import bits_set, in_table, membership, pieces, saved
from tidelens.llm.words import U64, hashes, mix, powers, tokens

#: A run's least number of sentences and of words, and the words from which one sentence is a run.
SENTENCES, WORDS, ALONE = 2, 20, 40


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sentences: text number, number of the first word, the number after the last word, and the byte (in the text) where it begins;
    also the words' hashes."""
    buf, starts, lengths, text = tokens(texts)
    n = len(starts)
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(4)), np.empty(0, U64)
    ends = starts + lengths
    last = buf[ends - 1]
    closes = (last == 46) | (last == 33) | (last == 63)
    breaks = np.cumsum((buf == 10) | (buf == 13))
    closes[:-1] |= breaks[starts[1:]] > breaks[ends[:-1] - 1]
    closes[:-1] |= text[1:] != text[:-1]
    closes[-1] = True
    stop = np.flatnonzero(closes) + 1
    first = np.r_[0, stop[:-1]]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return (text[first], first, stop, starts[first] - begins[text[first]]), hashes(buf, starts, lengths)


def runs(texts: list[bytes], least: int = SENTENCES, words: int = WORDS, alone: int = ALONE, ends: bool = False):
    """Two hashes of each run, its text number, and its first and last sentence (numbers in the text); no run twice."""
    (text, first, stop, _), h = sentences(texts)
    n = len(text)
    if not n:
        return np.empty(0, U64), np.empty(0, U64), *(np.empty(0, np.int64) for _ in range(3))
    enough = np.searchsorted(stop, first + words, "left")
    last = np.maximum(enough, np.arange(n) + least - 1)
    last = np.where(stop - first >= alone, np.arange(n), last)
    inside = last < n
    inside[inside] = text[last[inside]] == text[inside]
    i = np.flatnonzero(inside)
    last = last[inside]
    if ends:
        j = np.arange(n)
        back = np.minimum(np.searchsorted(first, stop - words, "right"), j - least + 2) - 1
        back = np.where(stop - first >= alone, j, back)
        new = back >= 0
        new[new] = text[back[new]] == text[new]
        forward = np.full(n, -1)
        forward[i] = last
        new[new] = forward[back[new]] != j[new]
        i, last = np.r_[i, back[new]], np.r_[last, j[new]]
    a, b = first[i], stop[last]
    own = np.searchsorted(text, text[i])
    out = []
    p = powers(len(h) + 1)
    inverse = inverse_powers(len(h) + 1)
    for salt in (1, 2):
        sums = np.r_[U64(0), np.cumsum(mix(h + U64(salt)) * p[: len(h)])]
        out.append(mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U64)))
    return out[0], out[1], text[i], i - own, last - own


_INVERSES = np.ones(1, U64)


def inverse_powers(n: int) -> np.ndarray:
    global _INVERSES
    if len(_INVERSES) < n:
        t = np.full(max(n, 2 * len(_INVERSES)), pow(int(powers(2)[1]), -1, 1 << 64), U64)
        t[0] = 1
        _INVERSES = np.multiply.accumulate(t)
    return _INVERSES[:n]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their covered sentences (columns: doc_id, text, firsts, lasts; null: none)."""
    for texts, rows in pieces(batches):
        (text, _, _, byte), _ = sentences(texts)
        count = np.bincount(text, minlength=len(texts))
        start = np.cumsum(count) - count
        removed, kept = [], []
        for i, (t, firsts, lasts) in enumerate(zip(texts, rows.column(2), rows.column(3), strict=True)):
            covered = np.zeros(count[i] + 1, np.int64)
            if firsts.is_valid:
                np.add.at(covered, firsts.values.to_numpy(), 1)
                np.add.at(covered, lasts.values.to_numpy() + 1, -1)
            gone = np.cumsum(covered)[:-1] > 0
            cuts = np.r_[byte[start[i] : start[i] + count[i]], len(t)].tolist()
            head = t[: cuts[0]] if count[i] else t
            kept.append(head + b"".join(t[cuts[k] : cuts[k + 1]] for k in np.flatnonzero(~gone).tolist()))
            removed.append(int(gone.sum()))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_sentences", "n_removed", "kept"])


KEPT = "doc_id long, n_sentences long, n_removed long, kept string"


def without_repeated_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ends: bool = False) -> DataFrame:
    """doc_id, n_sentences, n_removed and kept (the text without the sentences of any run that also begins earlier) per document with an id.

    ``ends``: runs that lead to a sentence count too, so that a repeated passage goes to its last sentence; without, only those from one.
    Earlier: in a document of smaller id, or before in the same one.  Null and empty texts have no sentences.  Rows of one id stand at the
    same place: they are reported each, and what one of them repeats goes from all of them.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    named = named.where("doc_id is not null")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in pieces(batches):
            values, c = np.unique(runs(texts, ends=ends)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(c > 1)], ["h1", "more"])

    counted = named.mapInArrow(counts, "h1 long, more boolean").groupBy("h1").agg(F.count("*").alias("n"), F.max("more").alias("more"))
    again = spark.sparkContext.broadcast(membership(counted.where("n > 1 or more").select("h1"), hashed=True))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            h1, h2, text, first, last = runs(texts, ends=ends)
            keep = bits_set(again.value, h1)
            ids = rows.column(0).to_numpy()[text[keep]]
            columns = [h1[keep].view(np.int64), h2[keep].view(np.int64), ids, first[keep], last[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "first", "last"])

    found = saved(named.mapInArrow(repeated, "h1 long, h2 long, doc_id long, first long, last long"), "runs")
    earliest = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "first")).alias("place"))
    later = found.join(earliest, ["h1", "h2"]).where(F.struct("doc_id", "first") > F.col("place")).select("doc_id", "first", "last")
    later = saved(later, "covered")
    table = spark.sparkContext.broadcast(membership(later.select("doc_id").distinct()))
    touched = in_table(table, F.xxhash64("doc_id"))
    by_doc = later.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("s")).select("doc_id", F.col("s.first").alias("firsts"), F.col("s.last").alias("lasts"))
    none = F.lit(None).cast("array<long>")
    free = named.where(~touched).select("doc_id", "text", none.alias("firsts"), none.alias("lasts"))
    rest = named.where(touched).join(by_doc, "doc_id", "left").select("doc_id", "text", "firsts", "lasts")
    return free.mapInArrow(_kept, KEPT).unionByName(rest.mapInArrow(_kept, KEPT))
