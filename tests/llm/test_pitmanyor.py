import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import pitmanyor
from tidelens.llm.pitmanyor import TABLED, Totals, contexts, draw_tables, predicted, sampled, score, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())) + [None]


def brute(rows, teaches):
    """(id, n_tokens, n_known, train_tokens, base_score) of every row."""
    lists = [(i, tokens(t)) for i, t in rows]
    c = Counter(w for i, ws in lists if teaches(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in lists)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    n_words, n_contexts = 7, 3
    word, context = (a.ravel() for a in np.meshgrid(np.arange(n_words), np.arange(n_contexts), indexing="ij"))
    count = rng.integers(0, 900, len(word)) * (rng.random(len(word)) < 0.7)
    customers = np.bincount(context, count, n_contexts)
    hot = np.array([-1, -1, 0, -1, 1, -1, -1])
    start = Totals(customers, np.ones(n_contexts), 100.0, n_words, n_words, 0.6, 0.4, np.array([9.0, 4.0]), np.array([2.0, 1.0]))
    totals = []
    for t, pc, pt in sampled(word, context, count, hot, start, 5):
        served = np.bincount(hot[word] + 1, t, 3)[1:]
        seats = np.array([2.0, 1.0])
        own = hot < 0
        totals.append(Totals(customers, np.bincount(context, t, n_contexts), pc[own].sum() + served.sum(), pt[own].sum() + seats.sum(), n_words, 0.6, 0.4, served, seats))
    p = predicted(word, context, count, hot, totals, start, 5)
    for u in range(n_contexts):
        unknown = sum((1 + now.discount * now.tables[u]) * now.parent(np.zeros(1), np.zeros(1))[0] / (1 + now.customers[u]) for now in totals) / len(totals)
        assert abs(p[context == u].sum() + unknown - 1) < 1e-9


def stirling_law(c, d, new):
    """P(t) of groups of c equal customers, from the recurrence, scaled row by row."""
    row = np.zeros(c + 2)
    row[1] = 1
    t = np.arange(c + 2)
    for n in range(1, c):
        row = np.maximum(n - d * t, 0) * row * (t <= n) + new * np.r_[0, row[:-1]]
        row /= row.sum()
    return row


@pytest.mark.parametrize("c", [2, 12, 31, 32, 33, TABLED - 1, TABLED, TABLED + 1, 3000])
@pytest.mark.parametrize("d,new", [(0.5, 0.8), (0.75, 2.0), (0.9, 0.02), (0.3, 30.0)])
def test_tables_follow_the_stationary_law_at_every_size(c, d, new):
    rng = np.random.default_rng(c)
    law = stirling_law(c, d, new)
    t = np.arange(len(law))
    mean = (law * t).sum()
    deviation = math.sqrt((law * (t - mean) ** 2).sum())
    drawn = draw_tables(np.full(3000, c), np.full(3000, new), d, rng)
    assert drawn.min() >= 1 and drawn.max() <= c
    assert abs(drawn.mean() - mean) < 0.02 * mean + 4 * deviation / math.sqrt(3000)
    assert abs(drawn.std() - deviation) < 0.1 * deviation + 0.05


def test_the_law_is_that_of_reseating_customers_one_by_one():
    rng = np.random.default_rng(1)
    c, d, new, chains = 40, 0.6, 1.5, 400
    sizes = np.zeros((chains, c))
    sizes[:, 0] = c
    rows, seen = np.arange(chains), []
    for step in range(4000):
        leaving = (np.cumsum(sizes, axis=1) > rng.random(chains)[:, None] * c).argmax(axis=1)
        sizes[rows, leaving] -= 1
        weight = np.where(sizes > 0, sizes - d, 0)
        x = rng.random(chains) * (weight.sum(axis=1) + new)
        old = (np.cumsum(weight, axis=1) > x[:, None]).argmax(axis=1)
        sizes[rows, np.where(x < weight.sum(axis=1), old, sizes.argmin(axis=1))] += 1
        if step > 2000:
            seen.append((sizes > 0).sum(axis=1).mean())
    drawn = draw_tables(np.full(4000, c), np.full(4000, new), d, rng)
    assert abs(drawn.mean() - np.mean(seen)) < 0.03 * np.mean(seen)


def test_no_customers_and_words_in_blocks():
    assert draw_tables(np.array([0, 1, 0]), np.ones(3), 0.5, np.random.default_rng(0)).tolist() == [0, 1, 0]
    texts = [b"a b", b"", b"c" * 50 + b" a", b"b", b""]
    whole, blocks = words(texts), words(texts, 8)
    assert all((a == b).all() for a, b in zip(whole, blocks, strict=True))
    assert whole[1].tolist() == [0, 0, 0, 1, 2, 2, 2, 3, 3, 4]
    u = contexts(whole[0], whole[2], np.sort(whole[0][:1]))
    assert u[[0, 3, 4, 7, 9]].tolist() == [0] * 5 and u[[1, 6]].tolist() == [1, 1] and (u[[2, 5, 8]] > 1).all()


def test_against_counts_and_odd_rows(make_docs, odd, odd_rows, nothing):
    rng = np.random.default_rng(3)
    vocabulary = ["w%d" % i for i in range(50)] + ["the"] * 30
    rows = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(80)] + [(200, "THE w1\tW2\nnever seen"), (200, "THE w1\tW2\nnever seen")]
    docs = make_docs(rows)
    for tokens_of_a_shard in (100, 1 << 20):
        got = score(docs, F.col("doc_id") % 3 != 0, common=0.05, context=0.1, shard_tokens=tokens_of_a_shard, piece_bytes=tokens_of_a_shard * 4).collect()
        assert sorted((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in got) == brute(rows, lambda i: i % 3 != 0)
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    got = score(odd, F.col("doc_id") != 6).collect()
    assert sorted((r[0], r[1], r[2], r[3], round(r[4], 6)) for r in got) == brute(odd_rows, lambda i: i != 6)
    assert score(nothing, F.lit(True)).count() == 0
    got = score(odd, F.lit(False)).collect()
    assert len(got) == 11 and {r["train_tokens"] for r in got} == {0}


def test_better_than_unigrams_on_held_out_text(spark):
    from tidelens.llm.queries import QUERIES

    got = QUERIES["op7_pitman_yor"](spark, "/root/testdata/sf0.01").groupBy("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).collect()
    for held_out, model, base, n in got:
        print(held_out, 10 ** (-model / n), 10 ** (-base / n))
        assert 10 ** (-model / n) < (0.7 if held_out else 0.25) * 10 ** (-base / n)
    assert pitmanyor.CLASSES + 1 / pitmanyor.CONTEXT + 1 < 1 << 15
