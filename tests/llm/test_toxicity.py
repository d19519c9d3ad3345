import numpy as np

from tidelens.llm.toxicity import STRETCH, features, fit, letters, score, train


def corpus(n=240):
    rng = np.random.default_rng(4)
    syllables = ["the", "on", "re", "ti", "an", "ea", "shi", "lo", "ber", "ou"]

    def sentence():
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(int(rng.integers(4, 9)))) + "."

    rows = []
    for i in range(n):
        body = [sentence() for _ in range(6)]
        if i % 3 == 0:
            body[2] = f"{sentence()[:-1]} {rng.choice(['numbskull', 'dunderhead', 'blockhead'])} {sentence()}"
        rows.append((i, " ".join(body), i % 3 == 0))
    return rows


def test_kernel_is_the_sum_over_shared_subsequences():
    a = features("abcd")
    codes = {tuple((c >> 5 * k) & 31 for k in (3, 2, 1, 0)): v for c, v in a.items()}
    assert set(codes) == {(0, 1, 2, 3), (31, 0, 1, 2), (31, 0, 1, 3), (31, 0, 2, 3), (31, 1, 2, 3)}
    assert abs(codes[(31, 0, 1, 3)] - 0.6 * codes[(0, 1, 2, 3)]) < 1e-12 and abs(sum(v * v for v in a.values()) - 1) < 1e-12
    s, begins, ends = letters([b"i d i o t, no", b"", b"x."])
    assert (s[begins[0] : ends[0]] + 97).astype(np.uint8).tobytes().replace(bytes([128]), b" ") == b" idiot no"
    assert ends[1] == begins[1] + 1 and (s[ends[0] : begins[1]] == 31).sum() == STRETCH  # each text begins with a break


def test_gapped_and_inserted_insults(spark, make_docs):
    rows = corpus()
    m = train([t.encode() for _, t, _ in rows], np.array([y for *_, y in rows]))

    def p(text):
        return float(m.probability(m.best([text.encode()]))[0])

    for insult in ("you numbskull", "you n u m b s k u l l", "dunder-head", "numbxskull", "BLOCKHEAD"):
        assert p(insult) >= 0.3, insult
    for clean in ("", "the shilo anber", "on re ti"):
        assert p(clean) < 0.3, clean


def test_query_columns_and_odd_rows(spark, make_docs, odd, nothing):
    rows = corpus()
    docs = make_docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in rows[:200]] + [(900, None, 1), (None, 1, 1)], "doc_id long, toxic int, n int")
    taught = docs.select("doc_id", "text").join(labels, "doc_id")
    m = fit(taught)
    got = {r["doc_id"]: r["score"] for r in score(docs, m).collect()}
    assert np.mean([(got[i] >= 0.3) == y for i, _, y in rows[200:]]) > 0.95
    found = score(odd, m).collect()
    assert len(found) == 11 and all(0 <= r["score"] <= 1 for r in found)
    assert fit(taught.limit(0)) is None and {r["score"] for r in score(odd, None).collect()} == {0.0}
    assert score(nothing, m).count() == 0


def test_held_out_quality(spark):
    from tidelens.llm.queries import QUERIES
    from tidelens.llm.shared import table

    sf = "/root/testdata/sf0.1"  # smaller tables teach too few of the insults that are held out
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, sf, "labels").collect()}
    got = [r for r in QUERIES["op6_toxicity_string_kernel"](spark, sf).where("held_out").collect() if r["doc_id"] in toxic]
    truth, said = np.array([toxic[r["doc_id"]] for r in got]), np.array([r["predicted"] for r in got])
    assert ((truth == 1) & (said == 1)).sum() >= 0.7 * (truth == 1).sum()
    assert ((truth == 0) & (said == 1)).sum() <= 0.05 * (truth == 0).sum()
