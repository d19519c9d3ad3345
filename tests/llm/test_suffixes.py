import numpy as np
import pytest

from tidelens.llm.suffixes import LENGTH, without_repeats


def brute(rows):
    """(id, removed, spans, kept) of each row, by all strings of LENGTH bytes."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - LENGTH + 1):
            s = b[p : p + LENGTH]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - LENGTH + 1):
            if first[b[p : p + LENGTH]] < (i, p):
                gone[p : p + LENGTH] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(1, 9))) for _ in range(n))


@pytest.mark.parametrize("hot", [1, 20000])
@pytest.mark.parametrize("batches", [1, 5])
def test_against_all_strings(make_docs, hot, batches):
    rng = np.random.default_rng(7)
    passages = [words(rng, 40) for _ in range(4)]
    rows = []
    for i in range(40):
        text = words(rng, int(rng.integers(0, 60)))
        for p in passages:
            if rng.random() < 0.4:
                cut = int(rng.integers(0, 60))
                text += " " + p[cut:] + " " + words(rng, int(rng.integers(0, 10)))
        rows.append((int(i * 3 % 41), text))
    rows += [(50, rows[0][1]), (51, rows[0][1]), (52, "ab" * 300), (53, "x" * 450), (54, "x" * 99), (55, "x" * 100)]
    got = without_repeats(make_docs(rows), batches=batches, hot=hot).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute(rows)


def test_odd_rows_and_carried_columns(odd, odd_rows, nothing):
    got = without_repeats(odd, carry=["source", "row"]).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == brute(odd_rows)
    assert {r["carried"]["source"] for r in got} == {"s"}
    assert without_repeats(nothing).count() == 0
