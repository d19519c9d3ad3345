import re

from tidelens.llm import decontam
from tidelens.llm.decontam import contaminated

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingle_set(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, items):
    out = []
    for i, t in docs:
        x = shingle_set(t)
        for k, u in items:
            q = shingle_set(u)
            if q and 4 * len(x & q) >= 3 * len(q):
                out.append((i, k, len(x & q), len(q)))
    return sorted(set(out))


def test_short_items_in_long_documents(spark, make_docs, odd, nothing):
    item = "Which of these numbers is the largest prime below one hundred and has two digits, the first being nine?"
    edited = item.replace("largest", "greatest")
    other = "What is the name of the long river that runs through the old town and then on into the northern sea at last?"
    filler = " ".join(f"word{i}" for i in range(3000))
    docs = [(1, filler + " " + item + " " + filler), (2, item.upper().replace(" ", " - ")), (3, edited), (4, filler), (5, item[:50]), (6, "two words"), (7, filler + other + " " + item), (7, item)]
    items = [(10, item), (11, other), (12, "two words"), (13, None), (14, ""), (None, item), (15, item)]
    frame = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, key string")
    got = contaminated(make_docs(docs), frame).collect()
    want = brute(docs, [(i, t) for i, t in items if i is not None])
    assert sorted(tuple(r)[:4] for r in got) == want and {(1, 10), (2, 10), (7, 11)} <= {(r[0], r[1]) for r in got}
    assert contaminated(odd, frame).count() == 0
    assert contaminated(nothing, frame).count() == 0
    assert contaminated(make_docs(docs), frame.limit(0)).count() == 0


def test_query_against_all_pairs(spark, sf):
    from tidelens.llm.queries import QUERIES
    from tidelens.llm.shared import table

    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    got = QUERIES["op5_minhash_containment"](spark, sf).collect()
    assert sorted(tuple(r)[:4] for r in got) == brute(docs, items)


def test_the_shortest_items_are_missed_seldom():
    """Five words are one shingle: a window of the first partition holds it among twice the partition's words."""
    for upper in decontam.bounds(100):
        k = decontam.values_needed(upper, 0.75)
        fewest = 1 if upper == decontam.FIRST else max(1, int(upper / decontam.GROWTH) + 1 - 4)
        similarity = 0.75 * fewest / (2 * upper + fewest - 0.75 * fewest)
        assert (1 - similarity) ** k <= decontam.MISS
