import random
from dataclasses import replace

import pytest

from tidelens.operators import attribution as att
from tidelens.schema import DEFAULT_VOCABULARY

V = replace(DEFAULT_VOCABULARY, touchpoints=("a", "b", "c"), order="buy")
DAY = 24 * 60


def brute(rows):
    out = []
    for u, t, k in rows:
        if k != "buy":
            continue
        touches = sorted((m, i, kk) for i, (uu, m, kk) in enumerate(rows) if uu == u and kk in V.touchpoints and t - DAY <= m < t)
        if touches:
            out.append((u, t, touches))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    r = [(u, rng.randrange(0, 6 * DAY), rng.choice(["a", "b", "c", "buy", "x"])) for u in range(4) for _ in range(150)]
    # edges: exactly 24 h before (in), at the conversion (out), two conversions sharing touches, no touch at all
    return r + [(9, 0, "a"), (9, DAY, "buy"), (9, DAY, "b"), (9, DAY + 1, "buy"), (10, 5, "buy"), (11, 7, "a"), (11, 8, "buy"), (12, 1, "a"), (12, 2, "b"), (12, 3, "buy")]


def credits(js, model, half=6.0):
    c = {}
    for _, t, touches in js:
        n = len(touches)
        for i, (m, _, k) in enumerate(touches):
            if model == "first_touch":
                w = float(i == 0)
            elif model == "last_touch":
                w = float(i == n - 1)
            elif model == "linear":
                w = 1 / n
            elif model == "time_decay":
                tot = sum(2 ** (-(t - x[0]) / 60 / half) for x in touches)
                w = 2 ** (-(t - m) / 60 / half) / tot
            else:
                w = 1.0 if n == 1 else 0.5 if n == 2 else 0.4 if i in (0, n - 1) else 0.2 / (n - 2)
            c[k] = c.get(k, 0) + w
    return {k: v for k, v in c.items() if v > 1e-9}


def test_journeys_and_models(make_events, rows):
    # times of one user may repeat: ties follow the event id, as in the brute force
    touches = att.conversion_touches(make_events(rows), V).persist()
    js = brute(rows)
    got = sorted((r["user_id"], r["n"], round(r["duration_mins"], 6)) for r in touches.collect())
    assert got == sorted((u, len(x), round(t - x[0][0], 6)) for u, t, x in js)
    all_models = att.credits(touches, V).collect()
    for model in att.MODELS:
        want = credits(js, model)
        mine = {r["touchpoint"]: r["conversions"] for r in all_models if r["model"] == model}
        assert mine == pytest.approx(want)
        assert sum(mine.values()) == pytest.approx(len(js))
    touches.unpersist()


def test_influence_counts_first_occurrence(make_events, rows):
    js = brute(rows)
    want = {}
    for _, _, x in js:
        seq = [k for _, _, k in x]
        for k in set(seq):
            i = seq.index(k)
            pos = "first" if i == 0 else "last" if i == len(seq) - 1 else "middle"
            w = want.setdefault(k, {"n": 0, "first": 0, "last": 0, "middle": 0})
            w["n"] += seq.count(k)
            w[pos] += 1
    got = {
        r["touchpoint"]: {"n": r["total_appearances"], "first": r["as_first_touch"], "last": r["as_last_touch"], "middle": r["as_middle_touch"]}
        for r in att.channel_influence(att.conversion_touches(make_events(rows), V), V).collect()
    }
    assert got == want


def test_top_paths(make_events, rows):
    want = {}
    for _, _, x in brute(rows):
        p = " -> ".join(k for _, _, k in x)
        want[p] = want.get(p, 0) + 1
    best = sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:10]
    got = [(r["path"], r["count"]) for r in att.top_paths(make_events(rows), V).collect()]
    assert got == best


def test_no_pair_join_in_the_plan(make_events, rows):
    plan = att.conversion_touches(make_events(rows), V)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_a_user_with_a_third_of_the_rows_is_spread(make_events):
    rng = random.Random(2)
    rows = [(0 if i % 3 == 0 else i, rng.randrange(0, 4 * DAY * 60) / 60, rng.choice(["a", "b", "buy"])) for i in range(6000)]
    units = att._in_units(make_events(rows), V, 24)
    for keys, most in ((("user_id", "unit"), 6000 // 200), (("user_id", "chunk", "unit"), 6000 // 200)):
        assert units.groupBy(*keys).count().agg({"count": "max"}).first()[0] <= most
    dealt = units.repartition(8, "user_id", "unit").selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_odd_look_backs(make_events, rows):
    """Look-backs that no minute divides."""
    for hours in (0.37, 24 * 7 + 1 / 3600):
        touches = att.conversion_touches(make_events(rows), V, lookback_hours=hours)
        span = int(hours * 3600e6) / 60e6
        want = sorted((u, sum(uu == u and k in V.touchpoints and t - span <= m < t for uu, m, k in rows)) for u, t, kind in rows if kind == "buy")
        assert sorted((r["user_id"], r["n"]) for r in touches.collect()) == [x for x in want if x[1]]


def test_path_hashes_tell_paths_apart(make_events, rows):
    js = [(" ".join(k for *_, k in x)) for _, _, x in brute(rows)]
    hashes = att.path_hashes(make_events(rows), V).select("n", "h0", "h1").collect()
    assert len(hashes) == len(js) and len({tuple(h) for h in hashes}) == len(set(js))
    assert "collect_list" not in att.path_hashes(make_events(rows), V)._jdf.queryExecution().toString()
