"""Quality by a sparse ensemble of rules: paths of boosted trees over text statistics, weighted by lasso logistic regression.

Statistics are Spark expressions over the whole text.  Trees grown on a bounded sample of labelled documents propose rules, conjunctions of
thresholds; the lasso keeps few of them.  The kept rules are compiled into one Spark expression, so scoring runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fit: labelled documents of each class at most, trees and their depth, shrinkage, bins of a statistic, least rows of a leaf.
SAMPLE, TREES, DEPTH, RATE, BINS, LEAF = 3000, 40, 3, 0.3, 64, 12
#: Share of the sample that chooses the penalty, and steps of each penalty of the path.
VALIDATION, PENALTIES, STEPS = 0.25, 10, 200
THRESHOLD = 0.7

WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """(parts, statistics): the statistics name the parts, which are computed first; all are finite for every text, an empty one too."""
    words, chars, lines, distinct = F.col("words"), F.col("chars"), F.col("lines"), F.col("distinct")
    parts = {
        "chars": F.length(text).cast("double"),
        "words": F.regexp_extract_all(text, F.lit(WORD), 0),
        "lines": F.filter(F.split(text, r"\n"), lambda x: F.length(x) > 0),
    }

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / F.greatest(chars, F.lit(1.0))

    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    stats = {
        "n_words": F.size(words).cast("double"),
        "word_length": F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w)) / n,
        "longest_word": F.aggregate(words, F.lit(0), lambda a, w: F.greatest(a, F.length(w))).cast("double"),
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "repeated_next": F.size(F.filter(F.slice(words, 2, F.size(words)), lambda w, i: w == F.get(words, i))) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "letterless_words": F.size(F.filter(words, lambda w: ~w.rlike(r"\p{L}"))) / n,
        "capitals": share(r"\p{Lu}"),
        "digits": share(r"\p{Nd}"),
        "signs": share(r"[#$%&*|<>{}=_~^\\/@\[\]]"),
        "exclamations": share("!"),
        "sentence_ends": F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / n,
        "commas": F.regexp_count(text, F.lit(",")) / n,
        "line_words": n / F.greatest(F.size(lines), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    }
    return parts, stats


@dataclass(frozen=True)
class Rule:
    """A conjunction: for each statistic (by number) lower < value <= upper."""

    bounds: tuple[tuple[int, float, float], ...]

    def covers(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for j, low, high in self.bounds:
            hit &= (x[:, j] > low) & (x[:, j] <= high)
        return hit

    def column(self, names: list[str]) -> Column:
        out = None
        for j, low, high in self.bounds:
            for c in ([F.col(names[j]) > F.lit(low)] if low > -np.inf else []) + ([F.col(names[j]) <= F.lit(high)] if high < np.inf else []):
                out = c if out is None else out & c
        return out


def _narrowed(rule: Rule, j: int, low: float, high: float) -> Rule:
    old = {k: (a, b) for k, a, b in rule.bounds}
    a, b = old.get(j, (-np.inf, np.inf))
    old[j] = (max(a, low), min(b, high))
    return Rule(tuple((k, *old[k]) for k in sorted(old)))


def tree(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on gradients: the rules of all its nodes but the root, and its leaves' steps for every row."""
    rules: list[Rule] = []
    step = np.zeros(len(g))
    open_nodes = [(Rule(()), np.arange(len(g)), 0)]
    while open_nodes:
        rule, rows, depth = open_nodes.pop()
        best, at = 1e-6, None
        gs, hs = g[rows].sum(), h[rows].sum()
        if depth < DEPTH and len(rows) >= 2 * LEAF:
            for j in columns:
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], BINS))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], BINS))[:-1]
                n = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(n < LEAF) | (n > len(rows) - LEAF)] = 0
                if gain.max() > best:
                    best, at = float(gain.max()), (j, int(gain.argmax()))
        if at is None:
            step[rows] = -RATE * gs / (hs + 1)
            continue
        j, k = at
        cut = float(cuts[j][k])
        left = binned[rows, j] <= k
        for part, side in ((rows[left], _narrowed(rule, j, -np.inf, cut)), (rows[~left], _narrowed(rule, j, cut, np.inf))):
            rules.append(side)
            open_nodes.append((side, part, depth + 1))
    return rules, step


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 5) -> list[Rule]:
    """Rules of boosted trees, each grown on half of the statistics; of rules that cover the same rows, the first."""
    rng = np.random.default_rng(seed)
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middle = (values[:-1] + values[1:]) / 2
        cuts.append(np.unique(np.quantile(middle, np.linspace(0, 1, BINS - 1), method="nearest")) if len(middle) else np.empty(0))
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    cuts = [np.r_[c, np.full(BINS - len(c), np.inf)] for c in cuts]
    f = np.full(len(y), np.log(weight[y].sum() / weight[~y].sum()))
    found: dict[bytes, Rule] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        chosen = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        rules, step = tree(binned, cuts, weight * (p - y), weight * p * (1 - p), chosen)
        f += step
        for r in rules:
            covered = r.covers(x)
            if LEAF <= covered.sum() <= len(x) - LEAF:
                found.setdefault(np.packbits(covered).tobytes(), r)
    return list(found.values())


def lasso_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, w: np.ndarray, b: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Minimises the weighted mean log loss plus ``penalty`` times the weights' absolute sum, by accelerated proximal steps from (w, b)."""
    weight = weight / weight.sum()
    rate = 4 / (np.linalg.norm(x * np.sqrt(weight)[:, None], 2) ** 2 + 1)
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = weight * (1 / (1 + np.exp(-np.clip(x @ vw + vb, -30, 30))) - y)
        nw, nb = vw - rate * (x.T @ r), vb - rate * r.sum()
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def log_loss(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray, b: float) -> float:
    z = x @ w + b
    return float((weight * (np.logaddexp(0, z) - y * z)).sum() / weight.sum())


class Ensemble:
    """The kept rules with their weights, and the intercept."""

    def __init__(self, names: list[str], rules: list[Rule], weights: np.ndarray, intercept: float):
        self.names, self.rules, self.weights, self.intercept = names, rules, weights, intercept

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = self.intercept + sum(w * r.covers(x) for r, w in zip(self.rules, self.weights, strict=True))
        return 1 / (1 + np.exp(-(z + np.zeros(len(x)))))

    def column(self) -> Column:
        """The probability as a Spark expression over columns named after the statistics."""
        z = F.lit(float(self.intercept))
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(self.names), F.lit(float(w))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def train(names: list[str], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Ensemble:
    """Rules from one part of the rows; the penalty of least loss on the other part weights them on all rows."""
    held = np.zeros(len(y), bool)
    held[np.random.default_rng(7).permutation(len(y))[: int(len(y) * VALIDATION)]] = True
    usable = y.any() and not y.all() and (y & ~held).any() and (~y & ~held).any()
    if not usable:  # one class only, or too few rows to learn from
        share = (weight[y].sum() + 1) / (weight.sum() + 2)
        return Ensemble(names, [], np.empty(0), float(np.log(share / (1 - share))))
    rules = tree_rules(x[~held], y[~held], weight[~held])
    z = np.stack([r.covers(x) for r in rules], axis=1).astype(np.float64) if rules else np.zeros((len(x), 0))
    scale = np.maximum(z.std(axis=0), 1e-9)
    z = z / scale
    wn = weight / weight.sum()
    b0 = float(np.log(wn[y].sum() / wn[~y].sum()))
    start = float(np.abs(z.T @ (wn * (y - wn[y].sum()))).max()) if rules else 1.0
    penalties = [start * 0.6**k for k in range(1, PENALTIES + 1)]
    w, b, losses = np.zeros(z.shape[1]), b0, []
    for p in penalties:
        w, b = lasso_logistic(z[~held], y[~held], weight[~held], p, w, b)
        losses.append(log_loss(z[held], y[held], weight[held], w, b) if held.any() else 0.0)
    w, b = np.zeros(z.shape[1]), b0
    for p in penalties[: int(np.argmin(losses)) + 1]:
        w, b = lasso_logistic(z, y, weight, p, w, b)
    kept = np.flatnonzero(w)
    return Ensemble(names, [rules[k] for k in kept], w[kept] / scale[kept], b)


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with one column for each statistic of the column ``text``, and their names."""
    parts, stats = statistics(F.col(text))
    return docs.withColumns(parts).select(*[c for c in docs.columns if c != text], *[c.cast("double").alias(n) for n, c in stats.items()]), list(stats)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = SAMPLE) -> Ensemble:
    """An ensemble from at most ``per_class`` documents of each label (0 or 1, others aside), chosen by a hash of the id; no text reaches the driver.

    Classes weigh what they are of all labelled rows.  An id with both labels counts for each; of several rows of one id and label, the one of
    least statistics is taken.  With labels of one class, or none, the score is their smoothed share.
    """
    usable = labelled.where(labelled[label_col].isin(0, 1) & labelled[id_col].isNotNull())
    keyed = usable.select(labelled[label_col].cast("int").alias("y"), labelled[id_col].cast("long").alias("id"), F.xxhash64(labelled[id_col].cast("long"), F.lit(13)).alias("at"))
    counts = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.count("*").alias("n")).collect()}
    ids = {y: sorted({r["id"] for r in keyed.where(F.col("y") == y).distinct().orderBy("at", "id").limit(per_class).collect()}) for y in counts}
    everything = sorted(set().union(*ids.values())) if ids else []
    text = F.coalesce(labelled[text_col].cast("string"), F.lit(""))
    chosen = usable.where(labelled[id_col].cast("long").isin(everything)) if everything else usable.limit(0)
    stats, names = with_statistics(chosen.select(labelled[id_col].cast("long").alias("id"), labelled[label_col].cast("int").alias("y"), text.alias("text")))
    one = stats.groupBy("id", "y").agg(F.min(F.struct(*names)).alias("least")).select("id", "y", "least.*")
    rows = sorted(tuple(r) for r in one.collect())
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(names))
    y = np.array([r[1] for r in rows], int)
    sizes = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    weight = np.array([counts[c] / sizes[c] for c in y.tolist()])
    return train(names, x, y == 1, weight / weight.mean() if len(weight) else weight)


def score(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (the probability that a label would be 1) for every document with an id; null texts are empty, and empty ones score too."""
    named = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    stats, _ = with_statistics(named)
    return stats.select("doc_id", ensemble.column().alias("score"))
