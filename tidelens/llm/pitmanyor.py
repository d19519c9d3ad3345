"""Language-model scores by a hierarchical Pitman-Yor model: Chinese-restaurant seating, sampled by Gibbs, averaged predictions.

* A restaurant for each frequent word, for each of ``CLASSES`` classes of the other words (by hash) and for the beginning of a text seats
  the words that follow it.  All share one parent restaurant, whose base is uniform over the vocabulary and one unknown word.
* The state of a group of equal customers is its number of tables.  A sweep draws it for every group from its law given all the rest,
  P(t) ~ S(c, t) new**t with the generalised Stirling numbers S, which holds for groups of every size.
* Texts come in pieces of 16 MB.  A piece sends each shard its different (context, word) pairs once, with their counts, and gets their
  probabilities back; the documents are put together again from the pieces.
* Words are dealt to shards by hash, with all their contexts; those of frequent words by word and context.  A shard seats its words alone:
  it needs only the tables of each restaurant and of the frequent words, which the shards sum up between rounds.
* The last round's samples are drawn twice with one seed: first for their table counts, then, with these, for the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import pieces, saved
from tidelens.llm.words import U64, hashes, mix, tokens

#: Shares of all tokens from which a word's pairs are dealt by context, and from which it has a restaurant of its own.
COMMON, CONTEXT = 2e-4, 1e-4
#: Restaurants that the other words share by hash; with at most 1 / CONTEXT own ones and the beginning they stay below 2**15.
CLASSES = 1 << 14
#: Tokens of a shard; bytes of a piece; sweeps of a round before its first sample; samples.
SHARD_TOKENS, PIECE_BYTES, SWEEPS, SAMPLES = 1 << 21, 1 << 24, 1, 4
#: Customers up to which the Stirling numbers are a table; beyond, its last row is scaled.
TABLED = 512
STRENGTH = 1.0
_END = U64(0x0E7D)  # stands for the end of a text; no word's hash is looked at here


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf, starts, lengths, text = tokens(texts)
    h = hashes(buf, starts, lengths)
    counts = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(h) + len(texts), U64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = _END, h
    return out, np.repeat(np.arange(len(texts)), counts + 1), np.r_[True, is_end[:-1]][: len(out)]


def words(texts: list[bytes], block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (each text's words, then its end), their text numbers, and which begin a text; hashed in blocks of bytes."""
    cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // block, prepend=-1)).tolist() + [len(texts)]
    parts = [(a, _words(texts[a:b])) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([p[0] for _, p in parts]), np.concatenate([p[1] + a for a, p in parts]), np.concatenate([p[2] for _, p in parts])


def place(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index in a sorted array, -1 where absent."""
    if not len(sorted_):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return np.where(sorted_[at] == values, at, -1)


def contexts(w: np.ndarray, begins: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Restaurant of each token: that of the word before, its class's if it is none of ``known``, the first at a beginning."""
    before = np.r_[U64(0), w[:-1]]
    own = place(known, before)
    shared = 1 + len(known) + (mix(before + U64(29)) % U64(CLASSES)).astype(np.int64)
    return np.where(begins, 0, np.where(own >= 0, 1 + own, shared)).astype(np.int16)


@dataclass
class Totals:
    """What shards need of the others: customers and tables of each restaurant, of the parent, of the frequent words, the vocabulary."""

    customers: np.ndarray
    tables: np.ndarray
    parent_customers: float
    parent_tables: float
    vocabulary: int
    discount: float
    parent_discount: float
    hot_customers: np.ndarray
    hot_tables: np.ndarray

    @property
    def fresh(self) -> float:
        """Weight of a new table of the parent."""
        return (STRENGTH + self.parent_discount * self.parent_tables) / (self.vocabulary + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - self.parent_discount * tables + self.fresh) / (STRENGTH + self.parent_customers)


@lru_cache(maxsize=4)
def stirling(discount: float, most: int = TABLED) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``most``: S(c+1, t) = S(c, t-1) + (c - discount t) S(c, t)."""
    out = np.full((most + 1, most + 2), -np.inf)
    out[1, 1] = 0
    t = np.arange(1, most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore"):
            stay = np.where(t <= c, np.log(np.maximum(c - discount * t, 1e-300)), -np.inf) + out[c, 1:-1]
        out[c + 1, 1:-1] = np.logaddexp(stay, out[c, :-2])
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - np.log(np.multiply.reduce([x + k for k in range(7)]))


def log_stirling(customers: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(c, t) up to a constant of c, for c beyond the table.

    S(c, t) discount**(t-1) gamma(t) gamma(1-discount) c**discount / gamma(c) tends to a function of t / c**discount alone; the table's last
    row gives that function.
    """
    most = TABLED
    k = np.arange(1.0, most + 1)
    knots = stirling(discount)[most, 1:-1] + (k - 1) * np.log(discount) + _lgamma(k) + lgamma(1 - discount) - lgamma(most) + discount * np.log(most)
    return np.interp(t * (most / customers) ** discount, np.r_[0, k], np.r_[0, knots]) - (t - 1) * np.log(discount) - _lgamma(t)


def _drawn(logits: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Column drawn in each row of weights given by their logarithms."""
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    p = np.cumsum(p, axis=1)
    return np.minimum((p < (rng.random(len(p)) * p[:, -1])[:, None]).sum(axis=1), p.shape[1] - 1)


class Groups:
    """Groups of equal customers, ordered by their numbers of customers once for all draws."""

    def __init__(self, customers: np.ndarray, discount: float):
        self.customers, self.discount = customers, discount
        some = np.flatnonzero(customers > 1)
        some = some[np.argsort(customers[some], kind="stable")]
        tabled = int(np.searchsorted(customers[some], TABLED, "right"))
        self.large = some[tabled:]
        sizes, starts = np.unique(customers[some[:tabled]], return_index=True)
        self.small = [(c, some[a:b]) for c, a, b in zip(sizes.tolist(), starts.tolist(), [*starts.tolist()[1:], tabled])]

    def draw(self, new: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Numbers of tables, each from its law given the rest; ``new``: weight of a new table."""
        tables = np.minimum(self.customers, 1).astype(np.float64)
        with np.errstate(divide="ignore"):
            log_new = np.log(new)
        for c, all_rows in self.small:
            t = np.arange(1.0, c + 1)
            s = stirling(self.discount)[c, 1 : c + 1]
            if c == 2:  # one table, or a second one
                tables[all_rows] += rng.random(len(all_rows)) * (np.exp(s[0]) + new[all_rows]) >= np.exp(s[0])
                continue
            step = max(1, (1 << 16) // c)
            for i in range(0, len(all_rows), step):
                rows = all_rows[i : i + step]
                tables[rows] = 1 + _drawn(s + t * log_new[rows, None], rng)
        steps = np.linspace(0, 1, 1025)
        for i in range(0, len(self.large), 256):
            rows = self.large[i : i + 256]
            c = self.customers[rows].astype(np.float64)[:, None]
            # cells of whole numbers of tables, wider the more there are; a number is drawn inside its cell
            edges = np.round(np.exp(steps * np.log(TABLED * (c / TABLED) ** self.discount + 1)))
            width, middle = np.diff(edges, axis=1), (edges[:, 1:] + edges[:, :-1] - 1) / 2
            with np.errstate(divide="ignore"):
                logits = log_stirling(c, np.maximum(middle, 1), self.discount) + middle * log_new[rows, None] + np.log(width)
            cell = _drawn(logits, rng)
            at = np.arange(len(rows))
            tables[rows] = np.minimum(edges[at, cell] + np.floor(rng.random(len(rows)) * width[at, cell]), c[:, 0])
        return tables


def draw_tables(customers: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    return Groups(customers, discount).draw(new, rng)


def sampled(word: np.ndarray, context: np.ndarray, count: np.ndarray, hot: np.ndarray, totals: Totals, seed: int, sweeps: int = SWEEPS, samples: int = SAMPLES):
    """Samples of (tables of each pair, parent customers and tables of each word) for pairs (word number, context, training count).

    ``hot``: for each word its number among the frequent ones, whose parent customers and tables are those of ``totals``; else -1.
    """
    rng = np.random.default_rng(seed)
    own, n_words = hot < 0, len(hot)
    theirs = np.maximum(hot, 0)
    tables = np.minimum(count, 1).astype(np.float64)
    fixed = [np.where(own, 0, a[theirs]) for a in (totals.hot_customers, totals.hot_tables)]
    parent_customers = np.where(own, np.bincount(word, tables, n_words), fixed[0])
    parent_tables = np.where(own, np.minimum(parent_customers, 1), fixed[1])
    weight = STRENGTH + totals.discount * totals.tables[context]
    groups = Groups(count, totals.discount)
    for step in range(sweeps + samples):
        tables = groups.draw(weight * totals.parent(parent_customers, parent_tables)[word], rng)
        parent_customers = np.where(own, np.bincount(word, tables, n_words), fixed[0])
        drawn = draw_tables(np.where(own, parent_customers, 0).astype(np.int64), np.full(n_words, totals.fresh), totals.parent_discount, rng)
        parent_tables = np.where(own, drawn, fixed[1])
        if step >= sweeps:
            yield tables, parent_customers, parent_tables


def predicted(word: np.ndarray, context: np.ndarray, count: np.ndarray, hot: np.ndarray, totals: list[Totals], seen: Totals, seed: int) -> np.ndarray:
    """Probability of each pair's word after its context, averaged over the samples; ``totals``: those of each sample."""
    p = np.zeros(len(word))
    theirs = np.maximum(hot, 0)
    for now, (tables, customers, parent_tables) in zip(totals, sampled(word, context, count, hot, seen, seed), strict=True):
        customers, parent_tables = (np.where(hot < 0, a, b[theirs]) for a, b in ((customers, now.hot_customers), (parent_tables, now.hot_tables)))
        base = now.parent(customers, parent_tables)[word]
        p += (np.maximum(count - now.discount * tables, 0) + (STRENGTH + now.discount * now.tables[context]) * base) / (STRENGTH + now.customers[context])
    return p / len(totals)


SHARD = "shard int, words binary, hot binary, word binary, context binary, count binary, pieces binary, sizes binary, inverse binary"
PACKET = "shard int, piece long, words binary, n binary, context binary, count binary"
PART = "piece long, shard int, a binary, b binary, c binary"
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _seed(shard: int) -> int:
    return 1000003 * (shard + 2)


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [f for f, _ in fields])


@dataclass
class Layout:
    """The different (word, context) pairs of a piece in the order of shard, word and context, and the pair of each token."""

    words: np.ndarray
    context: np.ndarray
    count: np.ndarray
    shard: np.ndarray
    token: np.ndarray
    sizes: np.ndarray
    piece: int


def laid_out(texts: list[bytes], teaches: np.ndarray, known: np.ndarray, hot: np.ndarray, shards: int, number: int) -> Layout:
    """``number``: of the piece in its partition.  A piece is named by it and its pairs, so pieces of one name have equal probabilities."""
    w, text, begins = words(texts)
    u = contexts(w, begins, known)
    named, number_of = np.unique(w, return_inverse=True)
    is_hot = place(hot, named) >= 0
    spread = np.where(is_hot[number_of], mix(u.astype(U64) + U64(1)), U64(0))
    shard = (mix(w + spread + U64(17)) % U64(shards)).astype(np.int64)
    bits = len(named).bit_length()
    if bits + 15 + shards.bit_length() > 63:
        raise OverflowError("too many different words in one text")
    key, token = np.unique((shard << (bits + 15)) | (number_of << 15) | u, return_inverse=True)
    w, u = named[(key >> 15) & ((1 << bits) - 1)], (key & 0x7FFF).astype(np.int16)
    count = np.bincount(token, teaches[text], len(key)).astype(np.int32)
    name = mix(mix(np.array([number], np.int64).view(U64)) + mix(w + u.astype(U64)).sum(dtype=U64) + U64(len(w)))
    return Layout(w, u, count, (key >> (bits + 15)).astype(np.int32), token.astype(np.int32), np.bincount(text, minlength=len(texts)), int(name.view(np.int64)[0]))


def score(docs: DataFrame, teaches: Column, id_col: str = "doc_id", text_col: str = "text", common: float = COMMON, context: float = CONTEXT, shard_tokens: int = SHARD_TOKENS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Scores of every document with an id by a model of those for which ``teaches`` (a condition on ``docs``) holds.

    doc_id, n_tokens (words and the end), n_known (of these, in the training tokens), train_tokens, base_score (add-one unigrams) and score
    (log10 of the model's probability of the text).  Null and empty texts are the end alone.  A null condition does not teach.  Repeated
    rows are reported each.  An empty table gives no rows; without training text every word is the unknown one.  ``docs`` is read four
    times and has to hold the same rows in the same order each time, as a stored table does; otherwise the job fails.
    """
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), F.coalesce(teaches, F.lit(False)).alias("teaches")).where("doc_id is not null")
    least = min(common, context)

    def learning(part: pa.RecordBatch) -> np.ndarray:
        return part.column(2).to_numpy(zero_copy_only=False).astype(bool)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words with half the least share of a piece's training tokens; kind 1: training tokens, kind 2: all tokens."""
        for texts, part in pieces(batches, limit=piece_bytes):
            w, text, _ = words(texts)
            h, c = np.unique(w[learning(part)[text]], return_counts=True)
            often = (c >= least / 2 * c.sum()) & (h != _END)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[h[often].view(np.int64), 0, 0]), pa.array(np.r_[c[often], c.sum(), len(w)].astype(np.int64)), pa.array(np.r_[np.zeros(int(often.sum())), 1, 2].astype(np.int32))], ["word", "c", "kind"])

    counted = saved(named.mapInArrow(frequent, "word long, c long, kind int").groupBy("word", "kind").agg(F.sum("c").alias("c")), "frequent")
    sums = {r["kind"]: r["c"] for r in counted.where("kind > 0").groupBy("kind").agg(F.sum("c").alias("c")).collect()}
    n, n_all = sums.get(1, 0), sums.get(2, 0)
    candidates = np.sort(counted.where((F.col("kind") == 0) & (F.col("c") >= least / 2 * n)).select("word").toArrow().column("word").to_numpy().view(U64))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros(len(candidates), np.int64)
        for texts, part in pieces(batches):
            w, text, _ = words(texts)
            at = place(candidates, w[learning(part)[text]])
            c += np.bincount(at[at >= 0], minlength=len(c))
        yield pa.RecordBatch.from_arrays([pa.array(candidates.view(np.int64)), pa.array(c)], ["word", "c"])

    found = named.mapInArrow(exact, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")).toArrow()
    often, often_c = found.column("word").to_numpy().view(U64), found.column("c").to_numpy()
    known = np.sort(often[often_c >= context * n])
    hot = np.sort(np.r_[often[often_c >= common * n], _END])
    n_contexts, n_hot = 1 + len(known) + CLASSES, len(hot)
    shards = max(1, -(-n_all // shard_tokens))

    def layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Layout, pa.RecordBatch]]:
        for i, (texts, part) in enumerate(pieces(batches, limit=piece_bytes)):
            yield laid_out(texts, learning(part), known, hot, shards, i), part

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in layouts(batches):
            cuts = np.searchsorted(x.shard, np.arange(shards + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[k], cuts[k + 1])
                first = np.flatnonzero(np.r_[True, x.words[mine][1:] != x.words[mine][:-1]])
                n_of = np.diff(np.r_[first, cuts[k + 1] - cuts[k]]).astype(np.int32)
                rows.append((k, x.piece, x.words[mine][first].tobytes(), n_of.tobytes(), x.context[mine].tobytes(), x.count[mine].tobytes()))
            yield _rows(PACKET, rows)

    def gathered(table: pa.Table) -> pa.Table:
        """A shard's words and pairs, and the pairs of each piece."""
        table = table.sort_by("piece")

        def whole(name: str, kind) -> np.ndarray:
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)

        w, u, count = np.repeat(whole("words", U64), whole("n", np.int32)), whole("context", np.int16), whole("count", np.int32)
        sizes = np.array([len(c) // 2 for c in table.column("context").to_pylist()], np.int32)
        pair, first, inverse = np.unique(mix(mix(w) + u.astype(U64)), return_index=True, return_inverse=True)
        named_, word = np.unique(w[first], return_inverse=True)
        order = np.lexsort((u[first], word))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        total = np.bincount(inverse, count, len(pair)).astype(np.int64)[order]
        columns = [named_, place(hot, named_).astype(np.int32), word[order].astype(np.int32), u[first][order], total, table.column("piece").to_numpy(), sizes, rank[inverse]]
        return pa.Table.from_batches([_rows(SHARD, [(table.column("shard")[0].as_py(), *(c.tobytes() for c in columns))])])

    stored = saved(named.mapInArrow(dealt, PACKET).repartition(min(shards, 100000), "shard").groupBy("shard").applyInArrow(gathered, SHARD), "shards")

    def opened(row: dict) -> tuple[np.ndarray, ...]:
        kinds = {"word": np.int32, "context": np.int16, "count": np.int64, "hot": np.int32}
        return tuple(np.frombuffer(row[k], kind).astype(np.int64) for k, kind in kinds.items())

    def summed(fn, width: int, block: int = 4096) -> np.ndarray:
        """Sum over all shards of the vectors that ``fn`` makes of a shard's pairs; it travels in blocks."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1).to_pylist()[0]
                    total += fn(row["shard"], *opened(row))
            yield _rows("at int, v binary", [(i, total[i : i + block].tobytes()) for i in range(0, width, block)])

        def added(table: pa.Table) -> pa.Table:
            v = np.sum([np.frombuffer(x, np.float64) for x in table.column("v").to_pylist()], axis=0)
            return pa.Table.from_batches([_rows("at int, v binary", [(table.column("at")[0].as_py(), v.tobytes())])])

        got = stored.select("shard", "hot", "word", "context", "count").mapInArrow(run, "at int, v binary").groupBy("at").applyInArrow(added, "at int, v binary").toArrow()
        out = np.zeros(width)
        for at, v in zip(got.column("at").to_pylist(), got.column("v").to_pylist(), strict=True):
            out[at : at + block] = np.frombuffer(v, np.float64)
        return out

    def by_hot(word: np.ndarray, values: np.ndarray, hot_of: np.ndarray) -> np.ndarray:
        return np.bincount(hot_of[word] + 1, values, n_hot + 1)[1:]

    def shape(_, word, u, c, hot_of) -> np.ndarray:
        """Customers and pairs of each context, tokens and pairs of each frequent word, figures of pairs and of other words."""
        some, own = (c > 0).astype(np.float64), hot_of < 0
        of_word, pairs = np.bincount(word, c, len(hot_of))[own], np.bincount(word, some, len(hot_of))[own]
        figures = [(c == 1).sum(), (c == 2).sum(), (of_word > 0).sum(), pairs.sum(), (pairs == 1).sum(), (pairs == 2).sum()]
        return np.r_[np.bincount(u, c, n_contexts), np.bincount(u, some, n_contexts), by_hot(word, c, hot_of), by_hot(word, some, hot_of), figures]

    customers, kinds, hot_count, hot_kinds, figures = np.split(summed(shape, 2 * (n_contexts + n_hot) + 6), np.cumsum([n_contexts, n_contexts, n_hot, n_hot]))
    one, two, cold_words, cold_pairs, parent_one, parent_two = figures
    rate = [float(np.clip(a / (a + 2 * b) if a else 0.5, 0.05, 0.95)) for a, b in ((one, two), (parent_one, parent_two))]
    vocabulary = int(cold_words + (hot_count > 0).sum())
    totals = Totals(customers, kinds, cold_pairs + hot_kinds.sum(), vocabulary, vocabulary, *rate, hot_kinds, np.minimum(hot_kinds, 1))

    def round_(now: Totals, samples: int, number: int) -> list[Totals]:
        def seated(shard, word, u, c, hot_of) -> np.ndarray:
            own = hot_of < 0
            states = sampled(word, u, c, hot_of, now, _seed(shard), samples=samples)
            return np.concatenate([np.r_[np.bincount(u, t, n_contexts), by_hot(word, t, hot_of), served[own].sum(), at[own].sum()] for t, served, at in states])

        out = []
        rng = np.random.default_rng(number)
        for s in summed(seated, samples * (n_contexts + n_hot + 2)).reshape(samples, -1):
            served = s[n_contexts:-2]
            seats = draw_tables(served.astype(np.int64), np.full(n_hot, now.fresh), now.parent_discount, rng)
            out.append(replace(now, tables=s[:n_contexts], parent_customers=s[-2] + served.sum(), parent_tables=s[-1] + seats.sum(), hot_customers=served, hot_tables=seats))
        return out

    for number in range(2):
        totals = round_(totals, 1, number)[-1]
    last = round_(totals, SAMPLES, 2)

    def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each piece the logarithms of its pairs' probabilities, and differences of their words' training counts."""
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                word, u, c, hot_of = opened(row)
                p = np.log10(predicted(word, u, c, hot_of, last, totals, _seed(row["shard"]))).astype(np.float32)
                count = np.where(hot_of < 0, np.bincount(word, c, len(hot_of)), hot_count[np.maximum(hot_of, 0)]).astype(np.int64)[word]
                inverse, ends = np.frombuffer(row["inverse"], np.int32), np.cumsum(np.frombuffer(row["sizes"], np.int32))
                for piece, at in zip(np.frombuffer(row["pieces"], np.int64).tolist(), np.split(inverse, ends[:-1]), strict=True):
                    yield _rows(PART, [(piece, row["shard"], p[at].tobytes(), np.diff(count[at], prepend=0).tobytes(), None)])

    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each piece with the places of their tokens' pairs, three bytes each where these suffice, byte by byte."""
        for x, part in layouts(batches):
            planes = x.token.view(np.uint8).reshape(-1, 4).T[: 3 if len(x.words) < 1 << 24 else 4]
            yield _rows(PART, [(x.piece, -1, part.column(0).to_numpy().tobytes(), x.sizes.astype(np.int64).tobytes(), planes.tobytes())])

    def put_together(table: pa.Table) -> pa.Table:
        replies = {r["shard"]: r for r in table.filter(pc.field("shard") >= 0).to_pylist()}
        if not replies:
            raise RuntimeError("the documents were not the same each time they were read")
        p_of, count_of = [], []
        for k in sorted(replies):
            p_of.append(np.frombuffer(replies[k]["a"], np.float32))
            count_of.append(np.cumsum(np.frombuffer(replies[k]["b"], np.int64)))
        p_of, count_of = np.concatenate(p_of).astype(np.float64), np.concatenate(count_of)
        base_of = np.log10((count_of + 1) / (n + vocabulary + 1))
        out = []
        for r in table.filter(pc.field("shard") < 0).to_pylist():
            ids, sizes = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.int64)
            planes = np.frombuffer(r["c"], np.uint8).reshape(-1, int(sizes.sum()))
            token = np.zeros((planes.shape[1], 4), np.uint8)
            token[:, : len(planes)] = planes.T
            token = token.view(np.int32).ravel()
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(v[token], starts) for v in ((count_of > 0).astype(np.int64), base_of, p_of)]
            out.append(pa.table([ids, sizes, *sums], [f.split()[0] for f in SCORED.split(", ")]))
        if not out:
            raise RuntimeError("the documents were not the same each time they were read")
        return pa.concat_tables(out)

    parts = stored.mapInArrow(probabilities, PART).unionByName(named.mapInArrow(outlines, PART))
    total = parts.repartition(min(shards, 100000), "piece").groupBy("piece").applyInArrow(put_together, SCORED)
    return total.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), "base_score", "score")
