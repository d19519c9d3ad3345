import math
import re
import zlib

import numpy as np

from tidelens.llm import ruleensemble as re_
from tidelens.llm.queries import QUERIES
from tidelens.llm.shared import table


def plain_statistics(text):
    """The statistics once more, in Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x]
    n, chars = max(1, len(words)), max(1, len(text))
    return {
        "n_words": len(words),
        "word_length": sum(map(len, words)) / n,
        "longest_word": max(map(len, words), default=0),
        "distinct_words": len(set(words)) / n,
        "repeated_next": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "short_words": sum(len(w) <= 3 for w in words) / n,
        "letterless_words": sum(not any(c.isalpha() for c in w) for w in words) / n,
        "capitals": sum(c.isupper() for c in text) / chars,
        "digits": sum(c.isdecimal() for c in text) / chars,
        "signs": sum(c in r"#$%&*|<>{}=_~^\/@[]" for c in text) / chars,
        "exclamations": text.count("!") / chars,
        "sentence_ends": len(re.findall(r"[.!?](?=[ \t\n\x0b\f\r]|\Z)", text)) / n,
        "commas": text.count(",") / n,
        "line_words": n / max(1, len(lines)),
        "distinct_lines": len(set(lines)) / max(1, len(lines)),
    }


def corpus(n=400):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(["the", "on", "re", "ti", "an", "shi"], rng.integers(1, 4))) for _ in range(int(rng.integers(20, 60)))]
        if i % 4 == 0:
            words = [w + " |" for w in words] if i % 8 else [words[0]] * len(words)
        rows.append((i, " ".join(words) + ".", int(i % 4 != 0)))
    return rows


def labelled(spark, rows, more=()):
    return spark.createDataFrame([(i, t, y, 1, "w") for i, t, y in [*rows, *more]], "doc_id long, text string, quality int, id int, words string")


def test_statistics_of_odd_texts(odd, odd_rows):
    docs = odd.where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') AS text")
    got, names = re_.with_statistics(docs)
    rows = sorted(tuple(r) for r in got.collect())
    want = sorted((i, *(plain_statistics(t or "")[n] for n in names)) for i, t in odd_rows)
    assert len(rows) == len(want) and names == list(plain_statistics(""))
    for a, b in zip(rows, want, strict=True):
        assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(a, b, strict=True)), (a, b)


def test_paths_of_a_tree_are_rules():
    rng = np.random.default_rng(0)
    x = rng.random((600, 6))  # each tree sees half of the columns
    y = (x[:, 0] > 0.5) & (x[:, 1] <= 0.3)
    rules = re_.tree_rules(x, y, np.ones(600))
    best = max(rules, key=lambda r: (r.covers(x) == y).mean())
    assert (best.covers(x) == y).mean() > 0.97 and {j for j, *_ in best.bounds} == {0, 1}
    assert len({np.packbits(r.covers(x)).tobytes() for r in rules}) == len(rules)


def test_lasso_meets_its_optimality_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6))
    y = rng.random(300) < 1 / (1 + np.exp(-2 * x[:, 0] + x[:, 1]))
    weight, penalty = rng.random(300) + 0.5, 0.05
    w, b = re_.lasso_logistic(x, y, weight, penalty, np.zeros(6), 0.0, steps=4000)
    r = weight / weight.sum() * (1 / (1 + np.exp(-(x @ w + b))) - y)
    g = x.T @ r
    assert abs(r.sum()) < 1e-6 and (w == 0).any() and (w != 0).any()
    assert np.allclose(g[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-6) and (np.abs(g[w == 0]) <= penalty + 1e-6).all()


def test_compiled_rules_equal_the_ensemble(spark, odd, odd_rows, nothing):
    rows = corpus()
    e = re_.fit(labelled(spark, rows, [(1000, None, 1), (1001, "x", None), (None, "x", 0), (3, rows[3][1], 1)]))
    docs = labelled(spark, rows)
    got = {r["doc_id"]: r["score"] for r in re_.score(docs, e).collect()}
    x = np.array([[plain_statistics(t)[n] for n in e.names] for _, t, _ in rows])
    assert np.allclose([got[i] for i, *_ in rows], e.probability(x), atol=1e-12) and e.rules
    assert np.mean([(got[i] >= re_.THRESHOLD) == (y == 1) for i, _, y in rows]) > 0.98
    found = re_.score(odd, e).collect()
    assert len(found) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in found)
    assert re_.score(nothing, e).count() == 0


def test_nothing_or_one_class_to_learn_from(spark, odd):
    for rows, share in (([], 0.5), ([(1, "only good", 1), (2, "texts", 1)], 0.75)):
        e = re_.fit(labelled(spark, rows))
        assert {round(r["score"], 9) for r in re_.score(odd, e).collect()} == {share}


def test_sample_is_bounded_when_one_id_fills_the_table(spark):
    rows = corpus(60) + [(4, f"row {i} of one id", 0) for i in range(500)]
    stats, names = re_.with_statistics(labelled(spark, rows).selectExpr("doc_id", "text"))
    assert stats.count() == 560
    e = re_.fit(labelled(spark, rows), per_class=20)
    assert len(e.names) == len(names)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    got = QUERIES["op13_rule_ensemble"](spark, sf).collect()
    assert len(got) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    good = [p for p, y in held if y == 1]
    bad = [p for p, y in held if y == 0]
    assert np.mean(good) >= 0.97 and np.mean(bad) <= 0.1
