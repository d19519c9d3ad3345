"""Suffix-array dedup: bytes that lie in a string of LENGTH bytes which also starts earlier, found with levels of hashed anchors.

* Suffixes are sampled.  Of the grams in each window of LENGTH bytes the one of least hash is its anchor, so equal windows have equal
  anchors at equal places, and the suffixes at anchors are all that is needed.  An entry of a suffix array is one anchor with the windows
  it stands for: the gram's hash (``key``, the order of the arrays), the hash of all bytes of those windows (``seg``), where they begin.
* Anchors that occur once in the whole input cannot match; fixed-size tables of the others keep them out.
* No suffix array is sorted by bytes: an anchor has a window's 100 bytes around it, so hashes find the same matches by joins.
* Batches of documents come in order of their ids.  A batch's entries are joined with the levels that exist: an entry whose ``seg``
  (by this 64-bit hash alone) is known is covered as a whole; where a key has several segs, their windows are sorted as suffixes and compared byte by byte.
* A level holds the first place of each seg.  Levels of equal size merge, so n batches leave log n levels.

A key with more than ``HOT`` different segs is not gathered: its windows become rows and are grouped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens.llm.shared import bits_set, folder, in_table, membership, partitions, pieces, remove, saved
from tidelens.llm.words import U64, mix

#: Bytes of a match and of an anchor's gram; batches; windows that are looked at together; different segs of a key in one task.
LENGTH, GRAM, BATCHES, STRIDE, HOT = 100, 24, 4, 1 << 17, 20000
#: Bytes of entries that one task compares at once, but for a single key's; arrays over their windows are some fifty times as large.
COMPARED = 1 << 20
_PLACE = 21  # bits of a position, more than STRIDE windows and the bytes around them need
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    t = _tables.get(base, np.ones(1, U64))
    if len(t) < n:
        t = np.full(n, base, U64)
        t[0] = 1
        t = _tables[base] = np.multiply.accumulate(t)
    return t[:n]


class Rolling:
    """Hashes of any stretch of a buffer, from sums of its bytes times powers (modulo 2**64)."""

    def __init__(self, buf: np.ndarray):
        self.sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(mix_bytes()[buf] * _power(_MULTIPLIER, len(buf)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _power(_INVERSE, len(self.sums))[start] + (end - start).astype(U64))

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * _power(_INVERSE, len(self.sums) - n))


def mix_bytes() -> np.ndarray:
    if 0 not in _tables:
        _tables[0] = mix(np.arange(7, 263, dtype=U64) * U64(_MULTIPLIER))
    return _tables[0]


def anchors(texts: list[bytes]) -> Iterator[dict[str, np.ndarray]]:
    """Entries of the texts, in parts: text number, key, seg, pos (first window), windows, and the buffer with each entry's place in it."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    whole = np.frombuffer(b"".join(texts), np.uint8)
    for c in range(0, len(whole), STRIDE):
        buf = whole[c : c + STRIDE + LENGTH - 1]
        n = len(buf) - LENGTH + 1
        if n <= 0:
            return
        roll = Rolling(buf)
        grams = roll.grams(GRAM)
        v = (grams >> U64(_PLACE)) << U64(_PLACE) | np.arange(len(grams), dtype=U64)
        width, want = 1, LENGTH - GRAM + 1
        while width * 2 <= want:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: len(v) - (want - width)], v[want - width :])[:n]
        at = (v & U64((1 << _PLACE) - 1)).astype(np.int64)
        text = np.searchsorted(begins, np.arange(c, c + n), "right") - 1
        inside = np.arange(c, c + n) + LENGTH <= (begins + sizes)[text]
        starts = np.flatnonzero(inside & np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]])
        ends = np.flatnonzero(inside & np.r_[(at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~inside[1:], True])
        key = grams[at[starts]]
        seg = mix(roll.of(starts, ends + LENGTH) + (at[starts] - starts).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        yield {"text": text[starts], "key": key, "seg": seg, "pos": starts + c - begins[text[starts]], "windows": ends - starts + 1, "off": at[starts] - starts, "buf": buf, "start": starts}


def _without_copies(texts: list[bytes], ids: list[int]) -> tuple[list[bytes], list[int]]:
    """One document, that of the smallest id, for each text of a piece; the others are copies as a whole."""
    first: dict[bytes, int] = {}
    for t, i in zip(texts, ids, strict=True):
        if len(t) >= LENGTH and (t not in first or i < first[t]):
            first[t] = i
    return list(first), list(first.values())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, rows in pieces(batches):
        texts, _ = _without_copies(texts, rows.column(0).to_pylist())
        for e in anchors(texts):
            order = np.lexsort((e["seg"], e["key"]))
            k, s = e["key"][order], e["seg"][order]
            new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])]) if len(k) else np.empty(0, int)
            more = np.diff(np.r_[new, len(k)]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(k[new].view(np.int64)), pa.array(s[new].view(np.int64)), pa.array(more)], ["key", "seg", "more"])


ENTRY = "key long, seg long, doc_id long, pos long, windows int, off int, bytes binary"


def _entries(repeated, mixed):
    """Function for mapInArrow: entries whose keys occur again; with their bytes where a key has several segs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            texts, ids = _without_copies(texts, rows.column(0).to_pylist())
            owner = np.array(ids, np.int64)
            for e in anchors(texts):
                spread = mix(e["key"])
                keep = np.flatnonzero(bits_set(repeated.value, spread))
                raw = e["buf"].tobytes()
                some = bits_set(mixed.value, spread[keep])
                a, b = e["start"][keep], e["start"][keep] + e["windows"][keep] + LENGTH - 1
                shown = [raw[i:j] if m else None for i, j, m in zip(a.tolist(), b.tolist(), some.tolist(), strict=True)]
                columns = [e["key"][keep].view(np.int64), e["seg"][keep].view(np.int64), owner[e["text"][keep]], e["pos"][keep], e["windows"][keep].astype(np.int32), e["off"][keep].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(shown, pa.binary())], [c.split()[0] for c in ENTRY.split(", ")])

    return run


def seen_before(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of different segs (several keys): row and window number of all windows that begin earlier in another seg of their key.

    The windows are suffixes of the joined bytes; those of equal hash are compared with the first of their kind byte by byte.
    """
    raw = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
    sizes = rows["windows"].to_numpy(np.int64)
    begins = np.cumsum(sizes + LENGTH - 1) - sizes - LENGTH + 1
    row = np.repeat(np.arange(len(rows)), sizes)
    number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    start = begins[row] + number
    h = Rolling(raw).of(start, start + LENGTH)
    h = mix(h ^ mix(rows["key"].to_numpy(np.int64).view(U64)[row]) + (rows["off"].to_numpy(np.int64)[row] - number).astype(U64))
    doc, pos = rows["doc_id"].to_numpy(np.int64)[row], rows["pos"].to_numpy(np.int64)[row] + number
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[1:] = h[order[1:]] == h[order[:-1]]
    again[:-1] |= again[1:]
    order = order[again]
    order = order[np.lexsort((pos[order], doc[order], h[order]))]
    if not len(order):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, h[order[1:]] != h[order[:-1]]]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.flatnonzero((doc[order] > doc[first]) | (pos[order] > pos[first]))
    same = np.empty(len(later), bool)
    windows = np.lib.stride_tricks.sliding_window_view(raw, LENGTH)
    for i in range(0, len(later), 1 << 14):
        part = later[i : i + (1 << 14)]
        same[i : i + (1 << 14)] = (windows[start[order[part]]] == windows[start[first[part]]]).all(axis=1)
    hit = order[later[same]]
    return row[hit], number[hit]


def _runs(row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a row put together: row, first and last window."""
    order = np.lexsort((number, row))
    r, n = row[order], number[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (n[1:] != n[:-1] + 1)
    last = np.r_[new[1:], True][: len(r)]
    return r[new], n[new], n[last]


SPAN = "doc_id long, start long, stop long"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered spans of the new entries among rows sorted by key (columns of ENTRY, then ``new``)."""

    def spans(table: pa.Table) -> pa.RecordBatch:
        rows = table.to_pandas()
        keys = rows["key"].to_numpy()
        several = np.r_[False, keys[1:] == keys[:-1]] if len(keys) else np.empty(0, bool)
        several[:-1] |= several[1:]
        rows = rows[several].reset_index(drop=True)
        out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        if len(rows):
            row, first, last = _runs(*seen_before(rows))
            new = rows["new"].to_numpy(bool)[row]
            row, first, last = row[new], first[new], last[new]
            pos = rows["pos"].to_numpy(np.int64)[row]
            out[0].append(rows["doc_id"].to_numpy(np.int64)[row])
            out[1].append(pos + first)
            out[2].append(pos + last + LENGTH)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["doc_id", "start", "stop"])

    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        keys = b.column(0).to_numpy()
        held.append(b)
        size += b.nbytes
        if size > COMPARED and keys[0] != keys[-1]:  # all but the last key are complete
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            held[-1] = b.slice(0, cut)
            yield spans(pa.Table.from_batches(held))
            held = [b.slice(cut)]
            size = held[0].nbytes
    if held:
        yield spans(pa.Table.from_batches(held))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the entries as a row, named by two hashes of its bytes."""
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            rows = pa.Table.from_batches([b.slice(i, 2048)]).to_pandas()
            raw = np.frombuffer(b"".join(rows["bytes"]), np.uint8)
            sizes = rows["windows"].to_numpy(np.int64)
            row = np.repeat(np.arange(len(rows)), sizes)
            number = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = (np.cumsum(sizes + LENGTH - 1) - sizes - LENGTH + 1)[row] + number
            roll = Rolling(raw)
            half = start + LENGTH // 2
            h1 = mix(roll.of(start, half) ^ rows["key"].to_numpy(np.int64).view(U64)[row])
            h2 = mix(roll.of(half, start + LENGTH) + U64(1))
            columns = [h1.view(np.int64), h2.view(np.int64), rows["doc_id"].to_numpy(np.int64)[row], rows["pos"].to_numpy(np.int64)[row] + number, rows["new"].to_numpy(bool)[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h1", "h2", "doc_id", "pos", "new"])


class SuffixIndex:
    """The levels, each a table of first places, and what new batches find in them."""

    def __init__(self, spark, hot: int = HOT):
        self.spark, self.hot, self.levels = spark, hot, []

    def _firsts(self, entries: DataFrame, name: str) -> tuple[str, DataFrame]:
        """A suffix array: each seg once, at its first place, in order of the keys."""
        place = F.struct("doc_id", "pos")
        found = entries.groupBy("key", "seg").agg(
            F.min(place).alias("place"), F.first("windows").alias("windows"), F.first("off").alias("off"), F.first("bytes", True).alias("bytes")
        )
        found = found.select("key", "seg", "place.doc_id", "place.pos", "windows", "off", "bytes").sortWithinPartitions("key", "seg")
        path = folder(self.spark, name)
        return path, saved(found, name, path)

    def add(self, entries: DataFrame, last: bool = False) -> DataFrame:
        """Spans of the batch (doc_id, start, stop) that also start earlier; the batch joins the levels unless it is the ``last``."""
        path, array = self._firsts(entries, "array")
        size = 1
        known = array.select("*", F.lit(True).alias("new"))
        for _, _, level in self.levels:
            known = known.union(level.select("*", F.lit(False).alias("new")))
        # an entry whose seg has an earlier place is covered as a whole
        firsts = known.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "pos")).alias("place"))
        whole = entries.join(firsts, ["key", "seg"]).where(F.struct("doc_id", "pos") > F.col("place"))
        whole = whole.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") + LENGTH - 1).alias("stop"))
        # the first places of different segs of a key: window by window
        known = known.where("bytes is not null")
        many = known.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("new").cast("int")).alias("fresh")).where("n > 1 and fresh = 1")
        hot = many.where(F.col("n") > self.hot)
        few = known.join(many.where(F.col("n") <= self.hot).select("key"), "key")
        parts = few.repartition(partitions(self.spark), "key").sortWithinPartitions("key").mapInArrow(_compared, SPAN)
        windows = known.join(hot.select("key"), "key").mapInArrow(_window_rows, "h1 long, h2 long, doc_id long, pos long, new boolean")
        earliest = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("place"))
        rest = windows.join(earliest, ["h1", "h2"]).where(F.col("new") & (F.struct("doc_id", "pos") > F.col("place")))
        rest = rest.select("doc_id", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("stop"))
        found = saved(whole.union(parts).union(rest), "spans")
        if last:
            return found
        while self.levels and self.levels[-1][0] == size:
            _, old, level = self.levels.pop()
            new_path, array = self._firsts(array.union(level), "level")
            remove(self.spark, old)
            remove(self.spark, path)
            path, size = new_path, size * 2
        self.levels.append((size, path, array))
        return found


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans (columns: doc_id, text, starts, stops in order of the starts, carried; null: none)."""
    for texts, rows in pieces(batches):
        out = []
        for t, starts, stops in zip(texts, rows.column(2), rows.column(3), strict=True):
            kept, removed, spans, at = [], 0, 0, 0
            if starts.is_valid and len(starts):
                a, b = starts.values.to_numpy(), np.maximum.accumulate(stops.values.to_numpy())
                new = np.flatnonzero(np.r_[True, a[1:] > b[:-1]])
                for i, j in zip(a[new].tolist(), b[np.r_[new[1:], len(a)] - 1].tolist(), strict=True):
                    kept.append(t[at:i])
                    removed, spans, at = removed + j - i, spans + 1, j
            kept.append(t[at:])
            out.append((len(t), removed, spans, b"".join(kept)))
        n, removed, spans, kept = zip(*out, strict=True)
        kinds = [pa.int64()] * 3 + [pa.binary()]
        yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip((n, removed, spans, kept), kinds, strict=True)), rows.column(4)], [*(c.split()[0] for c in KEPT.split(", ")), "carried"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the other bytes) of every document with an id.

    ``carry`` names columns of ``docs`` that come along in a struct ``carried``.

    A byte goes if it lies in a string of LENGTH bytes that also starts earlier: in a document of smaller id, or before in the same one.
    Null and empty texts, and texts below LENGTH bytes, keep all they have.  Rows of one id stand at the same place: they are reported each
    and take nothing from one another where they are equal.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    named = named.where("doc_id is not null")
    counted = named.mapInArrow(_counts, "key long, seg long, more boolean").groupBy("key").agg(
        ((F.count("*") > 1) | F.max("more")).alias("again"), (F.min("seg") < F.max("seg")).alias("several")
    )
    counted = saved(counted.where("again"), "keys")
    repeated, mixed = (spark.sparkContext.broadcast(_table(counted.where(c))) for c in ("again", "several"))

    marks = named.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000).alias("m")).first()["m"] or []
    cut = sum((F.when(F.col("doc_id") > m, 1).otherwise(0) for m in marks), F.lit(0))
    entries = named.mapInArrow(_entries(repeated, mixed), ENTRY).withColumn("batch", cut)
    entries = saved(entries, "entries")
    index, spans = SuffixIndex(spark, hot), None
    for b in range(len(marks) + 1):
        found = index.add(entries.where(F.col("batch") == b).drop("batch"), last=b == len(marks))
        spans = found if spans is None else spans.union(found)

    # copies of whole documents, which may have no entries
    digest = F.sha2("text", 256)
    copies = named.where(F.octet_length("text") >= LENGTH).select("doc_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n"))
    firsts = copies.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    copies = copies.join(firsts.select("digest", "first"), "digest").where("doc_id > first").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop"))
    spans = saved(spans.union(copies), "covered")

    table = spark.sparkContext.broadcast(membership(spans.select("doc_id").distinct()))
    touched = in_table(table, F.xxhash64("doc_id"))
    ordered = F.array_sort(F.collect_set(F.struct("start", "stop")))
    by_doc = spans.groupBy("doc_id").agg(ordered.alias("s")).select("doc_id", F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    carried = F.struct(*(docs[c] for c in carry)) if carry else F.lit(None).cast("struct<none:int>")
    full = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), carried.alias("carried")).where("doc_id is not null")
    rest = full.where(touched).join(by_doc, "doc_id", "left").select("doc_id", "text", "starts", "stops", "carried")
    schema = T._parse_datatype_string(KEPT).add("carried", full.schema["carried"].dataType)
    size = F.octet_length("text").cast("long")
    zero = F.lit(0).cast("long")
    free = full.where(~touched).select("doc_id", size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").cast("binary").alias("kept"), "carried")
    done = free.unionByName(rest.mapInArrow(_kept, schema))
    return done if carry else done.drop("carried")


def _table(keys: DataFrame) -> np.ndarray:
    """Membership by the kernel's own hash of the keys, which the tasks look up in numpy."""

    @F.pandas_udf("long")
    def spread(k: pd.Series) -> pd.Series:
        return pd.Series(mix(k.to_numpy(np.int64).view(U64)).view(np.int64))

    return membership(keys.select(spread("key").alias("key")), hashed=True)
