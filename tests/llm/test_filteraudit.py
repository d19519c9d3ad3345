import re
from collections import Counter
from itertools import permutations

from tidelens.llm import filteraudit
from tidelens.llm.queries import QUERIES
from tidelens.llm.shared import table

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    """Every order applied document by document; docs: (id, text, part), labels: (id, quality, toxic)."""
    docs = [(i, t or "", p or "") for i, t, p in docs if i is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    fails = []
    for i, t, p in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(j < i and u == t for j, u, _ in docs),
        }
        fails.append((i, p, {f for f, x in failed.items() if x}))
    out = {}
    sums = Counter()
    for order in permutations("ABCDE"):
        for part in {p for _, p, _ in fails}:
            left = [(i, f) for i, p, f in fails if p == part]
            everyone = list(left)
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                left = [(i, f) for i, f in left if name not in f]
                sums[part, name] += len(gone)
                failing = sum(name in f for _, f in everyone)
                alone = sum(f == {name} for _, f in everyone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in FIGURES) for r in df.collect()}


def audited(spark, docs, labels):
    d = spark.createDataFrame([(*r, 3, "k") for r in docs], "doc_id long, text string, source string, id int, part string")
    m = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, id int")
    return filteraudit.audit(d, m)


def test_every_order_equals_brute_force(spark):
    long = " ".join(f"word{i}" for i in range(230))
    docs = [
        (1, long, "a"),
        (2, long, "a"),
        (3, long + " #", "b"),
        (4, "same " * 240, "a"),
        (5, "SHOUT " * 240, None),
        (6, None, "a"),
        (7, "", "b"),
        (7, "", "b"),  # a repeated row is no copy of a smaller id, but counts
        (7, long + " other text of one id", "b"),
        (8, long.upper(), ""),
        (8, long, "c"),
        (None, long, "a"),
        (9, "x|" * 50000, "b"),
        (10, long + " #", "a"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (4, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (10, 0, 1), (7, 1, None)]
    got = rows_of(audited(spark, docs, labels))
    want = brute(docs, labels)
    assert len(want) == 600 * 4 and got == want  # parts a, b, c and the empty string
    assert rows_of(audited(spark, docs, [])) == {k: (*v[:4], 0, 0, v[6]) for k, v in want.items()}


def test_empty_tables(spark):
    assert rows_of(audited(spark, [], [(1, 1, 1)])) == {}


def test_given_tables(spark, sf):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in table(spark, sf, "documents").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in table(spark, sf, "labels").collect()]
    assert rows_of(QUERIES["op11_filter_audit"](spark, sf)) == brute(docs, labels)


