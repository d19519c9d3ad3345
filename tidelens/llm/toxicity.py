"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two stretches of letters counts the subsequences of ``LENGTH`` letters that they share, gaps allowed, each gap letter
weighted down by ``DECAY``; so `i d i o t`, `id.iot` or `idxiot` stay close to the insult.  The machine is linear in the kernel values
with a few landmark words, hence in the subsequences themselves: one table of weights scores every stretch of every sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import pieces

#: Letters of a subsequence, the widest stretch it may span, what each gap letter leaves of its weight, letters of a stretch.
LENGTH, SPAN, DECAY, STRETCH = 4, 6, 0.6, 12
#: The fit: labelled documents of each class at most, none above so many bytes; landmarks of each class; rounds of choosing stretches.
SAMPLE, SAMPLE_BYTES, LANDMARKS, ROUNDS = 1500, 20000, 48, 4
THRESHOLD = 0.3

_OFFSETS = [(0, *c) for c in combinations(range(1, SPAN), LENGTH - 1)]
_WEIGHTS = [DECAY ** (o[-1] + 1 - LENGTH) for o in _OFFSETS]
BREAK, DROPPED = 31, 255


def _symbols() -> np.ndarray:
    """Letters 0-25, look-alike digits as letters, letters beyond ASCII by their last byte 26-30; others are dropped."""
    s = np.full(256, DROPPED, np.uint8)
    for b in range(26):
        s[[65 + b, 97 + b]] = b
    for c, like in zip(b"013457@$", b"oieastas", strict=True):
        s[c] = like - 97
    s[0x80:0xC0] = 26 + np.arange(64) % 5
    return s


_SYMBOLS = _symbols()


def letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one stream of symbols, and where each text begins and ends in it.

    Breaks stand for the beginning, white space and, in a row, between texts.  Other signs vanish, and so does the space between single
    letters, so that spelt-out words close up.
    """
    buf = np.frombuffer(b"".join(b" " + t + b"\n" * STRETCH for t in texts), np.uint8)
    s = _SYMBOLS[buf]
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    s[space] = BREAK
    if len(buf) > 4:
        edge = space | ((s == DROPPED) & (buf < 128))
        spelt = space[2:-2] & edge[:-4] & edge[4:] & ~edge[1:-3] & ~edge[3:-1]
        s[2:-2][spelt] = DROPPED
    kept = np.flatnonzero(s != DROPPED)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes + STRETCH) - sizes - STRETCH
    return s[kept].astype(np.int32), np.searchsorted(kept, begins), np.searchsorted(kept, begins + sizes)


def codes(s: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """The subsequence at ``offsets`` from each position of the stream, as a number."""
    n = len(s) - SPAN + 1
    c = s[:n]
    for o in offsets[1:]:
        c = (c << 5) | s[o : o + n]
    return c


def features(word: str | bytes) -> dict[int, float]:
    """Weights of all subsequences of one word, as a unit vector; the break before the word may begin one."""
    s, _, _ = letters([word.encode() if isinstance(word, str) else word])
    s = np.r_[s, np.full(SPAN, BREAK, np.int32)]
    found: Counter = Counter()
    for o, w in zip(_OFFSETS, _WEIGHTS, strict=True):
        for c in codes(s, o).tolist():
            if all((c >> 5 * k) & 31 != BREAK for k in range(LENGTH - 1)):
                found[c] += w
    norm = np.sqrt(sum(v * v for v in found.values()))
    return {c: v / norm for c, v in found.items()}


class Landmarks:
    """Landmark words as rows over the subsequences that occur in them."""

    def __init__(self, words: list[str]):
        vectors = [features(w) for w in words]
        self.codes = np.array(sorted({c for v in vectors for c in v}), np.int32)
        self.rows = np.zeros((len(self.codes) + 1, len(words)), np.float32)  # the last row: none of them
        for j, v in enumerate(vectors):
            self.rows[np.searchsorted(self.codes, list(v)), j] = list(v.values())
        kernel = self.rows.T @ self.rows
        values, vectors_ = np.linalg.eigh(kernel.astype(np.float64))
        self.root = (vectors_ / np.sqrt(np.maximum(values, 1e-3))) @ vectors_.T

    def kernel(self, stretches: np.ndarray) -> np.ndarray:
        """Nyström features of stretches (rows of STRETCH symbols)."""
        out = np.zeros((len(stretches), self.rows.shape[1]), np.float32)
        padded = np.c_[stretches, np.full((len(stretches), SPAN - 1), BREAK, np.int32)]
        for o, w in zip(_OFFSETS, _WEIGHTS, strict=True):
            c = padded[:, : STRETCH - o[-1]]
            for k in o[1:]:
                c = (c << 5) | padded[:, k : k + STRETCH - o[-1]]
            at = np.minimum(np.searchsorted(self.codes, c), len(self.codes) - 1)
            at = np.where(self.codes[at] == c, at, len(self.codes))
            for i in range(0, len(c), 2048):
                out[i : i + 2048] += np.float32(w) * self.rows[at[i : i + 2048]].sum(axis=1)
        return out @ self.root

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The machine's weight of every possible subsequence."""
        t = np.zeros(32**LENGTH, np.float32)
        t[self.codes] = self.rows[:-1] @ (self.root @ weights)
        return t


def support_vector_machine(x: np.ndarray, y: np.ndarray, cost: float = 30.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps; both classes weigh the same."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    sign = np.where(y, 1.0, -1.0)
    c = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) * cost * 100
    w = np.zeros(x.shape[1])
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(steps):
        active = sign * (x @ w) < 1
        xa = x[active]
        new = np.linalg.solve(np.diag(ridge) + (xa * c[active, None]).T @ xa, xa.T @ (c[active] * sign[active]))
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


class Scorer:
    """The fitted machine: a table over subsequences, and the slope and offset that turn a document's best stretch into a probability."""

    def __init__(self, table: np.ndarray):
        self.table, self.slope, self.offset = table, 1.0, 0.0

    def stretches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stream, each text's begin and end, and the machine's value (without bias) of the stretch that begins at each position."""
        s, begins, ends = letters(texts)
        s = np.r_[s, np.full(STRETCH + SPAN, BREAK, np.int32)]
        n = len(s) - SPAN + 1
        sums = np.zeros((SPAN, n))
        for o, w in zip(_OFFSETS, _WEIGHTS, strict=True):
            sums[o[-1]] += np.float32(w) * self.table.take(codes(s, o))
        value = np.zeros(n - STRETCH + 1)
        for last in range(LENGTH - 1, SPAN):  # subsequences that end inside the stretch
            run = np.r_[0.0, np.cumsum(sums[last])]
            inside = STRETCH - last
            value += run[inside : inside + len(value)] - run[: len(value)]
        return s, begins, ends, value

    def best(self, texts: list[bytes]) -> np.ndarray:
        """Value of each text's best stretch; 0 where there is no letter."""
        if not texts:
            return np.empty(0)
        _, begins, ends, value = self.stretches(texts)
        best = np.maximum.reduceat(value, np.c_[begins, ends].ravel())[::2]
        return np.where(ends > begins, np.maximum(best, 0.0), 0.0)

    def probability(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30)))


def landmark_words(texts: list[bytes], toxic: np.ndarray, each: int) -> list[str]:
    """Words that tell the classes apart most, and common words of clean texts; none much like another."""
    seen = (Counter(), Counter())
    for t, y in zip(texts, toxic, strict=True):
        seen[int(y)].update(set(re.findall(r"[^\W\d_]{4,}", t.decode("utf-8", "replace").lower())))
    n = [max(1, int((~toxic).sum())), max(1, int(toxic.sum()))]
    odds = {w: np.log((c + 0.1) / n[1]) - np.log((seen[0][w] + 1) / n[0]) for w, c in seen[1].items() if c >= 2}
    ranked = sorted(odds, key=lambda w: (-odds[w] * np.log1p(seen[1][w]), w))[: each * 40], [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))[: each * 10]]
    chosen: list[str] = []
    vectors: list[dict[int, float]] = []
    for words in ranked:
        taken = 0
        for w in words:
            v = features(w)
            if taken < each and v and all(sum(x * u.get(c, 0) for c, x in v.items()) < 0.8 for u in vectors):
                chosen.append(w)
                vectors.append(v)
                taken += 1
    return chosen


def inserted(stretches: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Copies of the stretches with a random letter put in somewhere."""
    out = stretches.copy()
    for row, at in zip(out, rng.integers(2, STRETCH - 3, len(out)), strict=True):
        row[at + 1 :] = row[at:-1].copy()
        row[at] = rng.integers(26)
    return out


def train(texts: list[bytes], toxic: np.ndarray) -> Scorer | None:
    """A machine from labelled texts; None unless both classes occur.

    A toxic text stands for its worst stretch, which is chosen anew in each round, and for the same with a letter put in; a clean one for a
    random and for its worst stretch.
    """
    words = landmark_words(texts, toxic, LANDMARKS)
    if not words or toxic.all() or not toxic.any():
        return None
    marks = Landmarks(words)
    start = np.zeros(len(words))
    start[: min(LANDMARKS, len(words)) // 2] = 1
    scorer = Scorer(marks.table(np.linalg.solve(marks.root, start)))
    rng = np.random.default_rng(11)
    x: list[np.ndarray] = []
    for _ in range(ROUNDS):
        s, begins, ends, value = scorer.stretches(texts)
        spots, chance = [], []
        for a, b in zip(begins, ends, strict=True):
            spots.append(a + int(np.argmax(value[a:b])) if b > a else a)
            chance.append(int(rng.integers(a, max(b, a + 1))))
        take = np.r_[np.array(spots), np.array(chance)[~toxic]]
        y = np.r_[toxic, np.zeros(int((~toxic).sum()), bool), np.ones(int(toxic.sum()), bool)]
        chosen = s[take[:, None] + np.arange(STRETCH)]
        x.append(marks.kernel(np.r_[chosen, inserted(chosen[: len(toxic)][toxic], rng)]))
        clean = [f[~y] for f in x]  # earlier rounds' clean stretches stay
        fitted = np.concatenate([x[-1][y], *clean])
        weights, _ = support_vector_machine(fitted, np.r_[np.ones(int(y.sum()), bool), np.zeros(sum(map(len, clean)), bool)])
        scorer = Scorer(marks.table(weights))
    best = scorer.best(texts)
    design = np.c_[best, np.ones(len(best))]
    w = np.zeros(2)
    for _ in range(50):  # logistic regression with a slight ridge
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (p - toxic) + 0.1 * w
        w -= np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), g)
    scorer.slope, scorer.offset = w
    return scorer


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Scorer | None:
    """A machine from at most ``per_class`` documents of each label (null labels aside) of at most ``most_bytes``, by a hash of the id."""
    usable = labelled.where(labelled[label_col].isin(0, 1) & (F.octet_length(text_col) <= most_bytes) & labelled[id_col].isNotNull())
    keyed = usable.select(labelled[label_col].cast("int").alias("toxic"), labelled[id_col].alias("id"), F.xxhash64(labelled[id_col], F.lit(3)).alias("at"))
    # ids first, so that no text is sorted; their number is bounded
    ids = [r["id"] for y in (0, 1) for r in keyed.where(F.col("toxic") == y).orderBy("at", "id").limit(per_class).collect()]
    found = docs_of(usable, id_col, ids).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("toxic"), F.col(id_col).alias("id")).collect()
    found = sorted(found, key=lambda r: (r["toxic"], r["id"], r["text"]))
    return train([r["text"].encode() for r in found], np.array([bool(r["toxic"]) for r in found], bool)) if found else None


def docs_of(docs: DataFrame, id_col: str, ids: list) -> DataFrame:
    return docs.where(F.col(id_col).isin(ids)) if ids else docs.limit(0)


def score(docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability that a label would be toxic, from the text's worst stretch) for every document with an id.

    Null, empty and letterless texts get the score of a text without any likeness to an insult.  Without a machine all scores are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            p = scorer.probability(scorer.best(texts)) if scorer else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return named.where("doc_id is not null").mapInArrow(run, "doc_id long, score double")
