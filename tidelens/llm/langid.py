"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network labels every byte position with a probability for each language; a document's probabilities are the means over all its
positions.  Texts are walked in segments of ``STEPS`` bytes, thousands of them side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import pieces

#: Bytes of a segment, hidden units of a direction, segments walked side by side.
STEPS, HIDDEN, BESIDE = 64, 8, 2048
#: Training: labelled documents for each language at most (the fit is on a bounded sample), and optimiser steps of BATCH segments.
SAMPLE, UPDATES, BATCH, RATE = 1500, 300, 192, 0.02
UNKNOWN = "und"


def _half(x: np.ndarray) -> np.ndarray:
    """tanh in place; gates are kept as tanh(x / 2), so the logistic function is (1 + it) / 2."""
    return np.tanh(x, out=x)


class Network:
    """Parameters of both directions and of the output layer.

    Gates: z = s(Xz[byte] + h Uz), r = s(Xr[byte] + h Ur), n = tanh(Xn[byte] + r * (h Un)), h' = n + z * (h - n).
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {"b": np.zeros(len(languages), np.float32)}
        for d in "fb":
            for g in "zrn":
                self.p[f"X{g}{d}"] = rng.normal(0, 0.3, (256, hidden)).astype(np.float32)
                self.p[f"U{g}{d}"] = (rng.normal(0, 1, (hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p[f"W{d}"] = rng.normal(0, 0.1, (hidden, len(languages))).astype(np.float32)

    def walk(self, x: np.ndarray, d: str, keep: bool = False):
        """Hidden states of one direction for bytes ``x`` (steps, segments), in walking order; with ``keep`` also the gates."""
        p = self.p
        # halved inputs of the gates z and r, for the logistic function by tanh
        xz, xr, xn = p["Xz" + d] * np.float32(0.5), p["Xr" + d] * np.float32(0.5), p["Xn" + d]
        uz, ur, un = p["Uz" + d] * np.float32(0.5), p["Ur" + d] * np.float32(0.5), p["Un" + d]
        h = np.zeros((x.shape[1], len(un)), np.float32)
        states = np.empty((len(x), *h.shape), np.float32)
        gates = []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = _half(xz.take(x[t], 0) + h @ uz)
            r = _half(xr.take(x[t], 0) + h @ ur)
            z += 1
            z *= np.float32(0.5)
            r += 1
            r *= np.float32(0.5)
            m = h @ un
            n = r * m
            n += xn.take(x[t], 0)
            _half(n)
            new = h - n
            new *= z
            new += n
            if keep:
                gates.append((t, h, z, r, m, n))
            states[t] = h = new
        return (states, gates) if keep else states

    def positions(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Probabilities of every language from the states of both directions; the last axis is the language."""
        scores = forward @ self.p["Wf"]
        scores += backward @ self.p["Wb"]
        scores += self.p["b"]
        np.exp(scores, out=scores)
        scores /= scores.sum(-1, keepdims=True)
        return scores

    def gradients(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions (weighted) and its gradients, by backpropagation through time."""
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        walks = {d: self.walk(x, d, keep=True) for d in "fb"}
        probs = self.positions(walks["f"][0], walks["b"][0])
        total = weight.sum()
        loss = float(-(np.log(probs[:, np.arange(x.shape[1]), labels] + 1e-9) * weight).sum() / total)
        probs[:, np.arange(x.shape[1]), labels] -= 1
        delta = probs * (weight / total)[..., None]
        g["b"] = delta.sum((0, 1))
        for d, (states, gates) in walks.items():
            g["W" + d] = np.einsum("tbh,tbc->hc", states, delta)
            out = delta @ p["W" + d].T
            flow = np.zeros(states.shape[1:], np.float32)
            steps: dict[str, list] = {k: [] for k in "zrnmh"}
            order = [gate[0] for gate in reversed(gates)]
            for t, h, z, r, m, n in reversed(gates):
                flow = flow + out[t]
                dn = flow * (1 - z) * (1 - n * n)
                dz = flow * (h - n) * z * (1 - z)
                dm = dn * r
                dr = dn * m * r * (1 - r)
                for k, v in zip("zrnmh", (dz, dr, dn, dm, h), strict=True):
                    steps[k].append(v)
                flow = flow * z + dz @ p["Uz" + d].T + dr @ p["Ur" + d].T + dm @ p["Un" + d].T
            flat = {k: np.concatenate(v) for k, v in steps.items()}
            seen = x[order].ravel()
            for k, inner in ("zz", "rr", "nm"):
                g["U" + k + d] = flat["h"].T @ flat[inner]
                g["X" + k + d] = np.stack([np.bincount(seen, c, 256) for c in flat[k].T], 1).astype(np.float32)
        return loss, g

    def train(self, texts: list[bytes], labels: np.ndarray, updates: int = UPDATES, batch: int = BATCH, seed: int = 5) -> None:
        """Adam over random segments of the texts, every language as often as any other."""
        rng = np.random.default_rng(seed)
        by_label = [np.flatnonzero(labels == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for u in range(updates):
            y = rng.integers(len(by_label), size=batch)
            x = np.zeros((batch, STEPS), np.uint8)
            weight = np.zeros((batch, STEPS), np.float32)
            for i, k in enumerate(y):
                t = texts[rng.choice(by_label[k])]
                a = rng.integers(max(1, len(t) - STEPS + 1))
                part = np.frombuffer(t[a : a + STEPS], np.uint8)
                x[i, : len(part)], weight[i, : len(part)] = part, 1
            _, g = self.gradients(x.T, y, weight.T)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * min(1.0, 2 * (1 - u / updates))
            for k, v in g.items():
                v = v * np.float32(min(1.0, 1.0 / (norm + 1e-9)))
                m[k] += (v - m[k]) * np.float32(0.1)
                s[k] += (v * v - s[k]) * np.float32(0.01)
                self.p[k] -= (np.float32(rate) * (m[k] / (1 - 0.9 ** (u + 1))) / (np.sqrt(s[k] / (1 - 0.99 ** (u + 1))) + 1e-8)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all positions of every text (zeros where there is none)."""
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.array([len(t) for t in texts])
        segments = -(-counts // STEPS)
        owner = np.repeat(np.arange(len(texts)), segments)
        padded = np.frombuffer(b"".join(t.ljust(k * STEPS, b"\0") for t, k in zip(texts, segments.tolist(), strict=True)), np.uint8).reshape(-1, STEPS)
        length = np.full(len(owner), STEPS)
        last = np.cumsum(segments)[counts > 0] - 1
        length[last] = counts[counts > 0] - (segments[counts > 0] - 1) * STEPS
        for i in range(0, len(owner), BESIDE):
            x = np.ascontiguousarray(padded[i : i + BESIDE].T)
            ahead, back = self.walk(x, "f"), self.walk(x, "b")
            part = np.zeros((x.shape[1], len(self.languages)))
            inside = length[i : i + BESIDE]
            for t in range(STEPS):
                probs = self.positions(ahead[t], back[t])
                part += probs if (inside > t).all() else probs * (inside > t)[:, None]
            np.add.at(sums, owner[i : i + BESIDE], part)
        return sums / np.maximum(counts, 1)[:, None]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> list[tuple[bytes, str]]:
    """A stretch of at most 512 characters from anywhere in each of at most ``per_language`` documents of every language, by a hash of the id."""
    usable = docs.where(docs[text_col].rlike(r"\p{L}") & docs[lang_col].isNotNull())
    languages = usable.groupBy(usable[lang_col].cast("string").alias("lang")).count().collect()
    if not languages:
        return []
    # of each language only as many rows are sorted as fill the sample with some to spare
    place = F.pmod(F.xxhash64(docs[id_col], F.lit(1)), F.greatest(F.lit(1), F.length(docs[text_col]) - 511)) + 1
    share = F.create_map(*(F.lit(v) for r in languages for v in (r["lang"], min(1.0, (2 * per_language + 100) / r["count"]))))
    rows = usable.select(
        docs[lang_col].cast("string").alias("lang"),
        F.xxhash64(docs[id_col], F.lit(2)).alias("at"),
        docs[text_col].substr(place.cast("int"), F.lit(512)).alias("part"),
    ).where(F.pmod("at", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    order = Window.partitionBy("lang").orderBy("at", "part")
    rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).orderBy("lang", "at", "part")
    return [(r["part"].encode(), r["lang"]) for r in rows.select("part", "lang").collect() if r["part"]]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE, updates: int = UPDATES) -> Network | None:
    """A network trained on documents whose language is not null; None if there are none."""
    rows = training_sample(docs, id_col, text_col, lang_col, per_language)
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    net = Network(languages)
    net.train([t for t, _ in rows], np.array([languages.index(lang) for _, lang in rows]), updates)
    return net


def _judged(net: Network | None, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    names, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    some = [i for i, t in enumerate(texts) if any(map(str.isalpha, t.decode("utf-8")))]
    if net is not None and some:
        probs = net.documents([texts[i] for i in some])
        best = probs.argmax(1)
        names[some] = np.array(net.languages, object)[best]
        scores[some] = np.minimum(probs[np.arange(len(best)), best], 1.0)
    return names, scores


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the mean probability of that language over all positions) for every document with an id.

    Texts that are null or hold no letter, and all texts where nothing could be learned, get ``und`` and 0.  Equal probabilities: the
    first language by name.  Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches):
            names, scores = _judged(net, texts)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return named.where("doc_id is not null").mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_known_language(docs: DataFrame, net: Network | None, least_score: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) with an id whose text is in a language of the network, with at least that score.

    Rows stay where they are, so nothing is shuffled.  Null and letterless texts go.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches, at):
            names, scores = _judged(net, texts)
            yield rows.filter(pa.array((names != UNKNOWN) & (scores >= least_score)))

    return docs.where(docs[id_col].isNotNull()).mapInArrow(run, docs.schema)
