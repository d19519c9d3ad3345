import hashlib
import re
import zlib
from itertools import product

import numpy as np

from tidelens.llm import conversations as cv
from tidelens.llm.queries import QUERIES
from tidelens.llm.shared import table

ROLES = {"u": "user", "a": "assistant", "s": "system"}
LEGAL = re.compile(r"(s?(ua)+)?")


def exhaustive(signs):
    """The lightest repair among all edits with at most one inserted turn between two rows."""
    options = []
    for s in signs:
        found = [("D", "", 3)]
        if s != "D":
            extra = int(s.isupper())
            found += [("K", s.lower(), extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options += [[("", "", 0), ("I", "u", 2), ("I", "a", 2)], found]
    options.append([("", "", 0), ("I", "u", 2), ("I", "a", 2)])
    return min((sum(c for *_, c in p), "".join(e for e, *_ in p)) for p in product(*options) if LEGAL.fullmatch("".join(x for _, x, _ in p)))


def stepwise(signs):
    """The same row by row: lightest (cost, audit) of every state, with insertions relaxed between rows."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def inserts(best):
        for _ in range(3):
            for q, (c, a) in list(best.items()):
                for x, r in moves[q].items():
                    if x != "s":
                        best[r] = min(best.get(r, (99999, "")), (c + 2, a + "I"))

    inserts(best)
    for s in signs:
        new = {}
        for q, (c, a) in best.items():
            edits = [(q, c + 3, a + "D")]
            if s != "D":
                extra = int(s.isupper())
                edits += [(r, c + extra + (0 if x == s.lower() else 2), a + ("K" if x == s.lower() else "R")) for x, r in moves[q].items() if x == s.lower() or x != "s"]
            for r, *w in edits:
                new[r] = min(new.get(r, (99999, "")), tuple(w))
        inserts(new)
        best = new
    return min(best[q] for q in ("", "a") if q in best)


def brute(rows):
    """Expected row of every conversation; rows: (conv_id, turn, role, text) as given."""
    out = {}
    for conv in {r[0] for r in rows if r[0] is not None}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = (" " if v is None else v for v in (role, text))
            code = zlib.crc32(f"{conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
            left += [(turn, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
        out[conv] = brute_one(left)
    return out


def brute_one(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults, signs = set(), [], ""
    for _, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if blank else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0D]*\Z", text) else "truncated"
        seen.add((role, text))
        faults.append(fault)
        own = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signs += "D" if fault in ("blank", "duplicate") else own.upper() if fault else own
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit = stepwise(signs)
    kept, todo, position = [], iter(rows), 0
    for e in audit:
        role, text = ("", "") if e == "I" else next(todo)[1:]
        if e == "D":
            continue
        if e in "RI":
            begun = position - (1 if kept and kept[0].startswith("s") else 0)
            role = ("user", "assistant")[begun % 2]
        kept.append(f"{role}:{text}")
        position += 1
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 0) for r in rows], "conv_id long, turn int, role string, text string, at long, first string, n int")


def test_agenda_equals_all_edits():
    for n in range(4):
        for signs in product("suaxUD", repeat=n):
            signs = "".join(signs)
            assert cv.whole(signs) == exhaustive(signs) == stepwise(signs), signs
    rng = np.random.default_rng(1)
    for _ in range(300):
        signs = "".join(rng.choice(list("suaxSUAXD"), rng.integers(0, 40)))
        assert cv.whole(signs) == stepwise(signs), signs


def test_merged_pieces_equal_the_whole():
    rng = np.random.default_rng(2)
    for _ in range(60):
        signs = "".join(rng.choice(list("suaxUAD"), 30))
        tables = [cv.solved(signs[i : i + 5]) for i in range(0, 30, 5)]
        table = cv.merged([cv.merged(tables[:3]), cv.merged(tables[3:])])
        assert min(table[0, q][:2] for q in cv.GOALS if (0, q) in table) == cv.whole(signs)


ODD = [
    (None, 0, "user", "No conversation."),
    (1, 0, None, "A role of one space."),
    (1, 1, "user", None),
    (2, None, "user", "All turns are null?"),
    (2, None, "assistant", "They are."),
    (2, None, "assistant", "They are."),
    (3, 0, "system", "Be brief."),
    (3, 0, "system", "Be brief. Twice the same turn"),
    (3, 7, "user", "x" * 100000),
    (3, 9, "assistant", "Long gap!\n"),
    (4, 1, "", "An empty role."),
    (4, 2, "tool", "é" * 300 + "."),
    (5, 3, "user", ""),
    (6, -5, "assistant", "only one"),
]


def long_rows():
    rng = np.random.default_rng(3)
    texts = ["Yes.", "No!", "Why", "", "So it is?", "The end\n", "Same."]
    rows = [(70, int(t) if rng.random() > 0.1 else None, str(rng.choice(["user", "assistant", "system", "tool"])), str(rng.choice(texts)) + str(rng.integers(40))) for t in rng.integers(0, 150, 180)]
    return rows + [(71, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(90)] + [(72, None, "user", "Always the same.")] * 60


def test_whole_conversations(spark):
    rows = ODD + long_rows()
    df = frame(spark, rows)
    got = result(cv.repaired(df, cv.damaged(df)))
    assert got == brute(rows) and set(got) == {1, 2, 3, 4, 5, 6, 70, 71, 72}


def test_pieces_of_long_conversations(spark):
    rows = ODD + long_rows()
    damaged = cv.damaged(frame(spark, rows))
    found, pieces = cv.repair(damaged, rows_at_once=7, fan=3)
    got = result(found.join(cv.digests(pieces), "conv_id"))
    assert got == {k: v for k, v in brute(rows).items() if k in got} and {70, 71, 72} <= set(got)
    assert pieces.where("conv_id = 70 and n_pieces > 20").count() > 20


def test_nothing(spark):
    df = frame(spark, [])
    assert result(cv.repaired(df, cv.damaged(df))) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = frame(spark, [(dropped, 0, "user", "Gone.")])
    assert result(cv.repaired(df, cv.damaged(df))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    assert result(QUERIES["op12_conversation_repair"](spark, sf)) == brute(rows)
