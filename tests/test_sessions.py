import random
from functools import partial

import pytest
from pyspark.sql import functions as F

from tidelens.functions import distributed
from tidelens.operators import journeys, paths, sessions
from tidelens.schema import Vocabulary

V = Vocabulary(order="buy", journey_stages=("a", "b", "c", "buy"))


def brute(rows, timeout=30):
    """Sessions as lists of (minute, type) per user."""
    out = {}
    for i, (u, m, k) in enumerate(rows):
        out.setdefault(u, []).append((m, i, k))
    result = []
    for u, ev in out.items():
        ev.sort()
        cur, no = [], 0
        for e in ev:
            if cur and e[0] - cur[-1][0] > timeout:
                result.append((u, no + 1, cur))
                no, cur = no + 1, []
            cur.append(e)
        result.append((u, no + 1, cur))
    return result


def sample(seed=5, users=6):
    rng = random.Random(seed)
    rows = []
    for u in range(users):
        m = 0.0
        for _ in range(80):
            m += rng.choice([0, 0.5, 3, 10, 29, 30, 31, 70, 200])
            rows.append((u, m, rng.choice(["a", "b", "c", "buy"])))
    return rows


def test_edges_of_the_gap(make_events):
    rows = [(1, 0, "a"), (1, 30, "b"), (1, 60.00001, "c"), (2, 5, "a"), (3, 1, "a"), (3, 1, "b")]
    got = {(r["session_key"], r["event_count"], r["is_bounce"]) for r in sessions.sessions(make_events(rows), V).collect()}
    assert got == {("1_1", 2, False), ("1_2", 1, True), ("2_1", 1, True), ("3_1", 2, False)}


def test_sessions_equal_brute_force(make_events):
    rows = sample()
    got = {
        (r["user_id"], int(r["session_key"].split("_")[1])): (r["event_count"], r["entry_event"], r["exit_event"], r["converted"], round(r["duration_minutes"], 6))
        for r in sessions.sessions(make_events(rows), V).collect()
    }
    want = {(u, n): (len(s), s[0][2], s[-1][2], any(e[2] == "buy" for e in s), round(s[-1][0] - s[0][0], 6)) for u, n, s in brute(rows)}
    assert got == want


def test_sessions_do_not_depend_on_row_order(make_events):
    e = make_events(sample(9))
    key = ["session_key", "event_count", "entry_event"]
    a = sessions.sessions(e, V).select(key).collect()
    b = sessions.sessions(e.repartition(7, F.rand(1)), V).select(key).collect()
    assert sorted(a) == sorted(b)


def test_journeys_are_cut_and_converted_on_the_cut(make_events):
    rows = sample(2)
    got = {r["session_key"]: (r["journey"], r["converted"]) for r in journeys.journey_sequences(make_events(rows), V, 4).collect()}
    want = {}
    for u, n, s in brute(rows):
        j = [e[2] for e in s][:4]
        want[f"{u}_{n}"] = (j, "buy" in j)
    assert got == want


def test_time_between_stages_equals_brute_force(make_events):
    rows = sample(4)
    want = {}
    stages = V.journey_stages
    for _, _, s in brute(rows):
        for a, b in zip(stages, stages[1:]):
            ta = next((e[0] for e in s if e[2] == a), None)
            tb = next((e[0] for e in s if e[2] == b and ta is not None and e[0] > ta), None)
            if tb is not None:
                want.setdefault((a, b), []).append((tb - ta) * 60)
    got = {(r["from_stage"], r["to_stage"]): (r["sessions"], round(r["avg_seconds"], 4)) for r in journeys.time_between_stages(make_events(rows), V).collect()}
    assert got == {k: (len(x), round(sum(x) / len(x), 4)) for k, x in want.items()}


def test_long_session_over_many_chunks(make_events):
    rows = [(1, 20 * i, "a" if i % 2 else "b") for i in range(100)]
    s = sessions.sessions(make_events(rows), V).collect()
    assert len(s) == 1 and s[0]["event_count"] == 100 and s[0]["duration_minutes"] == 1980
    j = journeys.journey_sequences(make_events(rows), V, 10).first()
    assert j["journey"] == ["b", "a"] * 5


@pytest.mark.parametrize("most", [1, 7])
def test_busy_users_are_split_further(make_events, monkeypatch, most):
    """Chunks of days, hours, minutes and seconds side by side; sessions that go on over months."""
    rng = random.Random(11)
    rows = sample(6, users=3) + [(7, rng.randrange(0, 200 * 60) / 60, rng.choice(["a", "b", "buy"])) for _ in range(300)]
    rows += [(8, 29.0 * i, "a") for i in range(4000)] + [(9, 60 * 24 * 11 * i + j, "b") for i in range(20) for j in (0, 40)]
    plain = distributed.with_chunks
    for module in (sessions, distributed):
        monkeypatch.setattr(module, "with_chunks", partial(plain, most=most))
    got = {
        (r["user_id"], int(r["session_key"].split("_")[1])): (r["event_count"], r["entry_event"], r["exit_event"], r["converted"], round(r["duration_minutes"], 6))
        for r in sessions.sessions(make_events(rows), V).collect()
    }
    want = {(u, n): (len(s), s[0][2], s[-1][2], any(e[2] == "buy" for e in s), round(s[-1][0] - s[0][0], 6)) for u, n, s in brute(rows)}
    assert got == want
    steps = {}
    for u in {r[0] for r in rows}:
        seq = [k for *_, k in sorted((m, i, k) for i, (uu, m, k) in enumerate(rows) if uu == u)]
        for pair in zip(seq, seq[1:]):
            steps[pair] = steps.get(pair, 0) + 1
    counted = distributed.transition_counts(make_events(rows)).collect()
    assert {(r["event_type"], r["next_event"]): r["count"] for r in counted} == steps


def test_a_user_with_a_third_of_the_rows_is_spread(make_events):
    """The window of sessions and journeys is dealt by (user, chunk): no chunk is larger than the bound, no task far above the median."""
    rng = random.Random(12)
    rows = [(0 if i % 3 == 0 else i, rng.randrange(0, 4 * 24 * 3600) / 60, "a") for i in range(6000)]
    chunks = distributed.with_chunks(make_events(rows), most=40)
    assert chunks.groupBy("user_id", "chunk").count().agg({"count": "max"}).first()[0] <= 40
    dealt = chunks.repartition(8, "user_id", "chunk").selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    sizes = sorted(r["count"] for r in dealt)
    assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]


def test_duration_zero_is_in_no_bucket(make_events):
    s = sessions.sessions(make_events([(1, 0, "a"), (2, 0, "a"), (2, 0.5, "b")]), V)
    d = {r["duration_bucket"]: r["session_count"] for r in sessions.duration_distribution(s).collect()}
    assert d["<1min"] == 1 and sum(d.values()) == 1 and len(d) == 8


def test_paths(make_events):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 2, "buy"), (1, 3, "c"), (2, 0, "a"), (3, 0, "b"), (3, 1, "a"), (3, 2, "c")]
    e = make_events(rows)
    assert {(r["conversion_path"], r["users"]) for r in paths.paths_to_conversion(e, V).collect()} == {("a -> b -> buy", 1)}
    drop = {(r["after_path"], r["users"]) for r in paths.paths_to_drop_off(e, "a", V).collect()}
    assert drop == {("EXIT", 1), ("c", 1)}
    assert {r["entry_event"]: r["users"] for r in paths.entry_points(e, V).collect()} == {"a": 2, "b": 1}


@pytest.mark.parametrize("n", [3, 200])
def test_whole_paths_to_conversion_equal_brute_force(make_events, n):
    """Orders after thousands of events count, equal numbers go by the path's text, and long common beginnings are told apart."""
    rng = random.Random(13)
    rows = [(u, rng.randrange(0, 40 * 24 * 60), rng.choice(["a", "b", "buy"])) for u in range(30) for _ in range(12)]
    rows += [(100 + u, i, "a") for u in range(4) for i in range(50 + u // 2)] + [(100 + u, 5000, "buy") for u in range(4)]
    rows += [(200, i / 2, "b") for i in range(5000)] + [(200, 3000, "buy"), (200, 3001, "buy"), (201, 1, "a")]
    want = {}
    users = {r[0] for r in rows}
    for u in users:
        seq = [k for *_, k in sorted((m, i, k) for i, (uu, m, k) in enumerate(rows) if uu == u)]
        if "buy" in seq:
            path = " -> ".join(seq[: seq.index("buy") + 1])
            want[path] = want.get(path, 0) + 1
    best = sorted(want.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    got = [(r["conversion_path"], r["users"]) for r in paths.paths_to_conversion(make_events(rows), V, n).collect()]
    assert got == best
