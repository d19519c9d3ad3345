import numpy as np

from tidelens.llm.langid import Network, fit, in_known_language, predict


def test_gradients_match_differences():
    net = Network(["a", "b"], hidden=3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y, w = rng.integers(0, 4, (6, 5)).astype(np.uint8), rng.integers(0, 2, 5), np.ones((6, 5))
    _, g = net.gradients(x, y, w)
    for name in ("Xzf", "Xrb", "Xnf", "Uzb", "Urf", "Unb", "Wf", "b"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        kept = net.p[name][at]
        values = []
        for d in (1e-2, -1e-2):
            net.p[name][at] = kept + d
            values.append(net.gradients(x, y, w)[0])
        net.p[name][at] = kept
        assert abs((values[0] - values[1]) / 2e-2 - g[name][at]) < 2e-3


def test_languages_and_odd_rows(make_docs, odd, nothing):
    texts = [(i, ("the cat and the house of that " if i % 2 else "der hund und die katze nicht ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    docs = make_docs(texts + [(900, "the words", None)])
    net = fit(docs, updates=60)
    assert net.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in predict(docs, net).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in texts) >= 58
    assert all(0 <= r["score"] <= 1 for r in got.values())
    found = predict(odd, net).collect()
    assert len(found) == 11 and {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    kept = in_known_language(odd, net, 0.0)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {5, 6, 7, 8, 9, 10}
    assert fit(nothing) is None and predict(nothing, None).count() == 0
    assert {r["lang_pred"] for r in predict(odd, None).collect()} == {"und"}


def test_held_out_accuracy(spark, sf):
    from tidelens.llm.queries import QUERIES
    from tidelens.llm.shared import table

    lang = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op3_language_recurrent"](spark, sf).where("held_out").collect()
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in got if lang[r["doc_id"]]]) > 0.9


def test_memory_of_a_piece_is_bounded():
    """Arrays of a megabyte of text take less than 32 MB, so the workers of an executor leave room for its heap."""
    import tracemalloc

    from tidelens.llm.langid import Network

    net = Network(["a", "b", "c", "d"])
    text = bytes(range(65, 91)) * (1 << 20 >> 5)
    tracemalloc.start()
    net.documents([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20
