import re
from itertools import combinations

import numpy as np
import pytest

from tidelens.llm.jaccard import SKETCH, _alike, similar_components, sketches

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    return sorted((i, len(s), top(i)) for i, s in sets)


@pytest.mark.parametrize("frequent", [0, 50, 1 << 17])
def test_against_all_pairs(make_docs, frequent):
    rng = np.random.default_rng(2)
    vocabulary = ["w%d" % i for i in range(60)]
    rows = []
    shared = list(rng.choice(vocabulary, 30))
    for family in range(8):
        base = list(rng.choice(vocabulary, int(rng.integers(6, 90))))
        for _ in range(int(rng.integers(1, 12))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary)).upper()
            if rng.random() < 0.2:
                copy += shared
            rows.append((int(rng.permutation(10000)[0]) * 100 + len(rows), " ".join(copy)))
    rows += [(7, "one two"), (8, "ONE  two\n"), (9, "one two three"), (10, "a b c d e"), (11, "A b c d E")]
    got = similar_components(make_docs(rows), frequent=frequent).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(odd, odd_rows, nothing):
    got = similar_components(odd).collect()
    assert sorted(map(tuple, got)) == brute(odd_rows)
    assert similar_components(nothing).count() == 0


def test_sketches_rule_out_no_similar_pair(spark):
    """Sets at and about the threshold: those that link always pass, most of a family's others do not."""
    rng = np.random.default_rng(9)
    rows, linked = [], []
    for _ in range(300):
        n = int(rng.integers(1, 400))
        values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
        cut = int(rng.integers(0, n // 2 + 1))
        x, y = values[:n], values[cut : cut + n]
        marks = sketches(np.r_[x, y], np.repeat([0, 1], n), 2).view(np.int64).tolist()
        rows.append((len(rows), n, n, *marks[0], *marks[1]))
        linked.append(4 * (n - cut) >= 3 * (n + cut))
    names = ["i", "n", "m", *("x" + s for s in SKETCH), *("y" + s for s in SKETCH)]
    passed = {r["i"] for r in spark.createDataFrame(rows, names).where(_alike("n", "m", "x", "y")).select("i").collect()}
    assert passed >= {i for i, yes in enumerate(linked) if yes}
    assert len(passed) < sum(linked) + 0.25 * (len(rows) - sum(linked))


def test_family_members_apart_are_not_joined(make_docs, monkeypatch):
    """Copies of one text with too many edits share its frequent tokens, but their pairs do not come to the comparison."""
    from tidelens.llm import jaccard

    rng = np.random.default_rng(3)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.choice(30, 5, replace=False):
            copy[int(k) * 5 + 2] = f"x{i}y{k}"
        rows.append((i, " ".join(copy)))
    sizes = {}
    store = jaccard.saved

    def counted(df, name, path=None):
        out = store(df, name, path)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", counted)
    assert sorted(map(tuple, similar_components(make_docs(rows)).collect())) == brute(rows)
    assert sizes["pairs"][-1] < 0.2 * len(rows) * (len(rows) - 1) / 2
