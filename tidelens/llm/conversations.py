"""Repair of conversations: lightest derivations of a weighted hypergraph, found by Knuth's agenda.

A conversation's roles should read `(s?(ua)+)?` (system, user, assistant).  An item [i, q] says that the first i rows can be edited into a
string that leads the automaton of that language to state q.  Deductions keep, rerole or delete the next row or insert an empty turn; their
weights are (cost, audit), ordered by cost and then by the audit's bytes.  Extending an audit on its right never makes it lighter, so the
functions are monotone and superior and the agenda may finalise the lightest open item, until the goal is final.

A long conversation is cut into pieces of its sorted rows.  A piece is solved from each state to each state; a deduction over pieces joins
an item [pieces before k, q] with the piece's own item [q, r].  Pieces are merged in groups, level by level, and the states that the goal's
derivation passes are handed down again, so no task holds a conversation of unbounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.shared import partitions, saved

#: Fixed values of the task: costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows and bytes of a conversation that is repaired as a whole, and of a piece of a longer one; pieces merged at once.
ROWS, BYTES, FAN = 256, 1 << 22, 64

#: The automaton: what follows each state; 0 before any turn, 1 after the system's, 2 after the user's, 3 after the assistant's.
NEXT: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
GOALS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

Weight = tuple[int, str]
#: Lightest weights from a state to a state, with the states that a merged item passes between its pieces.
Table = dict[tuple[int, int], tuple[int, str, str]]


def sign(initial: str, forced: bool, truncated: bool) -> str:
    """A row as one letter: D if it must go, else its role's initial (x: none that fits), capital if truncated."""
    if forced:
        return "D"
    letter = initial if initial in ("s", "u", "a") else "x"
    return letter.upper() if truncated else letter


def deductions(signs: str, i: int, q: int) -> Iterator[tuple[int, int, int, str]]:
    """(position, state, cost, edit) of every deduction from the item [i, q]."""
    follows = NEXT[q]
    for letter in follows:
        if letter != "s":
            yield i, follows[letter], INSERT, "I"
    if i == len(signs):
        return
    yield i + 1, q, DELETE, "D"
    s = signs[i]
    if s == "D":
        return
    extra = TRUNCATED if s.isupper() else 0
    own = s.lower()
    if own in follows:
        yield i + 1, follows[own], extra, "K"
    for letter in follows:
        if letter != "s" and letter != own:
            yield i + 1, follows[letter], REROLE + extra, "R"


def lightest(signs: str, entry: int, goals: Iterable[int] | None) -> dict[int, Weight]:
    """Lightest (cost, audit) from state ``entry`` over all rows to each state; with ``goals``, only to the first of these that is final."""
    n, final, found = len(signs), set(), {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == n:
            found[q] = (cost, audit)
            if goals is not None and q in goals:
                return {q: found[q]}
        for j, r, weight, edit in deductions(signs, i, q):
            if (j, r) not in final:
                heappush(agenda, (cost + weight, audit + edit, j, r))
    return found


@lru_cache(1 << 16)
def whole(signs: str) -> Weight:
    """Lightest repair of a whole conversation."""
    ((_, found),) = lightest(signs, 0, GOALS).items()
    return found


def solved(signs: str) -> Table:
    """A piece from every state to every state."""
    return {(p, q): (*w, "") for p in range(len(NEXT)) for q, w in lightest(signs, p, None).items()}


def merged(tables: list[Table]) -> Table:
    """Consecutive pieces as one: the agenda over items [pieces before k, q]; a piece's own items are final already."""
    out: Table = {}
    for p in range(len(NEXT)):
        final: set[tuple[int, int]] = set()
        agenda: list[tuple[int, str, int, int, str]] = [(0, "", 0, p, "")]
        while agenda:
            cost, audit, k, q, passed = heappop(agenda)
            if (k, q) in final:
                continue
            final.add((k, q))
            if k == len(tables):
                out[p, q] = (cost, audit, passed)
                continue
            for r in range(len(NEXT)):
                own = tables[k].get((q, r))
                if own and (k + 1, r) not in final:
                    heappush(agenda, (cost + own[0], audit + own[1], k + 1, r, passed + (str(r) if k + 1 < len(tables) else "")))
    return out


def edited(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The (role, text) rows after the edits of an audit that begins in ``state``."""
    out: list[tuple[str, str]] = []
    left = iter(rows)
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(left)
        if edit == "D":
            continue
        letter = role[:1]
        if edit in "RI":
            (letter,) = (x for x in NEXT[state] if x != "s")
            role = ROLES[letter]
        out.append((role, text))
        state = NEXT[state][letter]
    return out


# --- figures of consecutive rows --------------------------------------------------------------

FIGURES = "n_rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
_FIGURES = [c.split()[0] for c in FIGURES.split(", ")]


def figures(rows: list[dict]) -> dict:
    """Counts over sorted rows with turn, role, blank, duplicate, truncated (each row's first fault only)."""
    known = [r["turn"] for r in rows if r["turn"] is not None]
    initials = [r["role"][:1] for r in rows]
    return {
        "n_rows": len(rows),
        **{c: sum(r[c] for r in rows) for c in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
        "first": initials[0],
        "last": initials[-1],
        "low": min(known, default=None),
        "high": max(known, default=None),
        "turns": len(set(known)),
    }


def joined(a: dict, b: dict) -> dict:
    """Figures of two neighbouring stretches; rows are sorted by turn, so they share a turn only where they meet."""
    out = {c: a[c] + b[c] for c in ("n_rows", "blank", "duplicate", "truncated", "illegal", "turns")}
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    return out | {"first": a["first"], "last": b["last"], "low": a["low"] if a["low"] is not None else b["low"], "high": b["high"] if b["high"] is not None else a["high"]}


def gaps(low: Column, high: Column, turns: Column) -> Column:
    return F.coalesce(high - low + 1 - turns, F.lit(0)).cast("long")


# --- Spark ------------------------------------------------------------------------------------

_ROW = ["conv_id", "turn", "role", "text", "blank", "ends"]
_EDITED = "array<struct<role:string,text:string>>"
_TABLE = "table array<struct<p:int,q:int,cost:long,audit:string,passed:string>>"


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, blank, ends): nulls of role and text as one space; rows without a conversation take no part."""
    c = conversations
    rows = c.where(c["conv_id"].isNotNull()).select(
        c["conv_id"].cast("long").alias("conv_id"),
        c["turn"].cast("long").alias("turn"),
        *[F.coalesce(c[x].cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")],
    )
    return rows.select("*", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ends"))


def _order() -> list[Column]:
    return [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _runs(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[list[dict]]:
    """Stretches of the sorted rows, each of one conversation; with ``rows``, of so many at most and of about ``BYTES``."""
    held: list[dict] = []
    room = BYTES
    for b in batches:
        for r in b.to_pylist():
            if held and (r["conv_id"] != held[0]["conv_id"] or rows and (len(held) >= rows or room <= 0)):
                yield held
                held, room = [], BYTES
            held.append(r)
            room -= len(r["text"])
    if held:
        yield held


def _marked(rows: list[dict]) -> str:
    """Sets each row's first fault and gives the signs; ``duplicate`` says whether role and text were seen earlier."""
    for r in rows:
        r["duplicate"] = r["duplicate"] and not r["blank"]
        r["truncated"] = not (r["blank"] or r["duplicate"] or r["ends"])
    return "".join(sign(r["role"][:1], r["blank"] or r["duplicate"], r["truncated"]) for r in rows)


def _whole_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    size = 0
    for rows in _runs(batches):
        seen: set[tuple[str, str]] = set()
        for r in rows:
            key = (r["role"], r["text"])
            r["duplicate"] = key in seen
            seen.add(key)
        cost, audit = whole(_marked(rows))
        done = edited([(r["role"], r["text"]) for r in rows], audit, 0)
        out.append(figures(rows) | {"conv_id": rows[0]["conv_id"], "cost": cost, "audit": audit, "edited": [{"role": a, "text": b} for a, b in done]})
        size += sum(len(r["text"]) for r in rows)
        if len(out) >= 2000 or size >= BYTES:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


_LONG, _TEXT = pa.int64(), pa.string()
_TYPES = {c.split()[0]: (_LONG if c.split()[1] == "long" else _TEXT) for c in FIGURES.split(", ")} | {"conv_id": _LONG, "cost": _LONG, "audit": _TEXT, "part": pa.int32(), "no": _LONG, "at": _LONG}
_TYPES["edited"] = _TYPES["rows"] = pa.list_(pa.struct([("role", _TEXT), ("text", _TEXT)]))
_TYPES["table"] = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", _LONG), ("audit", _TEXT), ("passed", _TEXT)]))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema([(c, _TYPES[c]) for c in rows[0]]))


def _listed(table: Table) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a, "passed": s} for (p, q), (c, a, s) in table.items()]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Pieces of long conversations, numbered within the partition.  ``seen``: role and text occur at an earlier turn."""
    last, no = None, 0
    for rows in _runs(batches, most):
        for r in rows:
            key = (r["conv_id"], r["turn"], r["role"], r["text"])
            r["duplicate"] = r["seen"] or key == last  # equal rows are neighbours, and in one partition
            last = key
        table = solved(_marked(rows))
        no += 1
        body = [{"role": r["role"], "text": r["text"]} for r in rows]
        yield _batch([figures(rows) | {"conv_id": rows[0]["conv_id"], "part": rows[0]["part"], "no": no, "table": _listed(table), "rows": body}])


def _merge(group: pa.Table, fan: int) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: r["at"])
    total = rows[0]
    for r in rows[1:]:
        total = joined(total, r)
    tables = [{(t["p"], t["q"]): (t["cost"], t["audit"], t["passed"]) for t in r["table"]} for r in rows]
    out = {c: total[c] for c in _FIGURES} | {"conv_id": rows[0]["conv_id"], "at": rows[0]["at"] // fan, "table": _listed(merged(tables))}
    return pa.Table.from_batches([_batch([out])])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            (audit,) = (t["audit"] for t in r["table"] if (t["p"], t["q"]) == (r["p"], r["q"]))
            done = edited([(x["role"], x["text"]) for x in r["rows"]], audit, r["p"])
            yield _batch([{"conv_id": r["conv_id"], "at": r["at"], "edited": [{"role": a, "text": t} for a, t in done]}])


def repair(conversations: DataFrame, rows_at_once: int = ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(figures, pieces) of every conversation with rows.

    figures: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  pieces: conv_id, at, n_pieces, edited (the repaired rows, as an
    array of role and text): one piece for a conversation of at most ``rows_at_once`` rows, in order of ``at`` otherwise.

    Rows are taken by turn (nulls first), rows of one turn by role and text in byte order.  A null role or text is one space; such a row is
    blank, or fits nowhere unless its role changes.  Rows without a conversation's id take no part; a repeated row is a duplicate.  A role
    without letters has no initial and fits nowhere.  An empty table gives empty results.
    """
    rows = saved(prepared(conversations), "conversation-rows")
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    long = saved(sizes.where((F.col("n") > rows_at_once) | (F.col("size") > BYTES)).select("conv_id"), "conversation-long")
    some = not long.isEmpty()
    short = rows.join(long, "conv_id", "left_anti") if some else rows
    schema = f"{FIGURES}, conv_id long, cost long, audit string, edited {_EDITED}"
    done = saved(short.repartition("conv_id").sortWithinPartitions(*_order()).select(*_ROW).mapInArrow(_whole_conversations, schema), "conversation-short")
    found = done.select("conv_id", gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    texts = done.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("n_pieces"), "edited")
    if some:
        more, long_texts = _repair_long(rows.join(long, "conv_id", "left_semi"), rows_at_once, fan)
        found, texts = found.unionByName(more), texts.unionByName(long_texts)
    return found, texts


def _repair_long(rows: DataFrame, most: int, fan: int) -> tuple[DataFrame, DataFrame]:
    turn = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)))
    digest = F.unhex(F.sha2("text", 256))
    keyed = rows.withColumn("digest", digest).withColumn("t", turn)
    first = keyed.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("t").alias("t0"), F.max("t").alias("t1")).where("t0 < t1").drop("t1")
    marked = saved(keyed.join(first, ["conv_id", "role", "digest"], "left").select(*_ROW, F.coalesce(F.col("t") > F.col("t0"), F.lit(False)).alias("seen")), "conversation-marked")
    # ranges of the sorted rows: a conversation of any length is dealt over many tasks
    n = partitions(rows.sparkSession)
    dealt = marked.repartitionByRange(n, "conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 32)).sortWithinPartitions(*_order())
    pieces = saved(dealt.select(*_ROW, "seen", F.spark_partition_id().alias("part")).mapInArrow(lambda batches: _pieces(batches, most), f"{FIGURES}, conv_id long, part int, no long, {_TABLE}, rows {_EDITED}"), "conversation-pieces")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = pieces.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("no").alias("from"))
    offsets = parts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("from")).alias("offset"))
    leaves = pieces.join(offsets, ["conv_id", "part"]).withColumn("at", F.col("offset") + F.col("no"))
    levels = [saved(leaves.select("conv_id", "at", *_FIGURES, "table"), "conversation-level")]
    while levels[-1].agg(F.max("at")).first()[0] > 0:
        groups = levels[-1].groupBy("conv_id", F.floor(F.col("at") / fan))
        levels.append(saved(groups.applyInArrow(lambda group: _merge(group, fan), f"{FIGURES}, conv_id long, at long, {_TABLE}"), "conversation-level"))
    goal = F.array_min(F.transform(F.filter("table", lambda t: (t["p"] == 0) & t["q"].isin(*GOALS)), lambda t: F.struct(t["cost"].alias("cost"), t["audit"].alias("audit"), t["q"].alias("q"))))
    top = levels[-1].withColumn("goal", goal)
    found = top.select("conv_id", gaps(F.col("low"), F.col("high"), F.col("turns")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("goal.cost").alias("cost"), F.col("goal.audit").alias("audit"))
    # the states that the goal's derivation passes, from the top level down to the pieces
    passed = top.select("conv_id", "at", F.lit(0).alias("p"), F.col("goal.q").alias("q"))
    for level in reversed(levels[1:]):
        item = F.filter("table", lambda t: (t["p"] == F.col("p")) & (t["q"] == F.col("q")))[0]["passed"]
        states = F.concat(F.col("p").cast("string"), F.col("item"), F.col("q").cast("string"))
        opened = level.select("conv_id", "at", "table").join(passed, ["conv_id", "at"]).withColumn("item", item).withColumn("states", states)
        child = opened.select("conv_id", "at", "states", F.posexplode(F.sequence(F.lit(1), F.length("states") - 1)).alias("k", "i"))
        passed = child.select("conv_id", (F.col("at") * fan + F.col("k")).alias("at"), F.substring("states", F.col("i"), F.lit(1)).cast("int").alias("p"), F.substring("states", F.col("i") + 1, F.lit(1)).cast("int").alias("q"))
    ends = leaves.select("conv_id", "at", "table", "rows").join(saved(passed, "conversation-states"), ["conv_id", "at"])
    texts = saved(ends.select("conv_id", "at", "table", "rows", "p", "q").mapInArrow(_finish, f"conv_id long, at long, edited {_EDITED}"), "conversation-long-texts")
    counts = texts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_pieces"))
    return found, texts.join(counts, "conv_id").select("conv_id", "at", "n_pieces", "edited")


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's `role:text` lines, joined by newlines.

    A digest is made in order, so the pieces of a long conversation stream through one task, sorted, one piece at a time.
    """
    lines = F.transform("edited", lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    made = pieces.select("conv_id", "at", "n_pieces", F.size("edited").alias("n"), F.array_join(lines, "\n").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, begun = None, None, False
        for b in batches:
            for conv, n, body in zip(*(b.column(c).to_pylist() for c in ("conv_id", "n", "body")), strict=True):
                if conv != now:
                    if h is not None:
                        yield pa.RecordBatch.from_pydict({"conv_id": [now], "repaired_sha256": [h.hexdigest()]})
                    now, h, begun = conv, hashlib.sha256(), False
                if n:
                    h.update((b"\n" if begun else b"") + body.encode())
                    begun = True
        if h is not None:
            yield pa.RecordBatch.from_pydict({"conv_id": [now], "repaired_sha256": [h.hexdigest()]})

    one = made.where("n_pieces = 1").select("conv_id", F.sha2("body", 256).alias("repaired_sha256"))
    many = made.where("n_pieces > 1").repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "n", "body")
    return one.unionByName(many.mapInArrow(run, "conv_id long, repaired_sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after faults set by the checksum of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?`
    out of it, 3 repeats it, 4 makes its role `user`.  Nulls are one space, in the checksum too; a null turn stays null otherwise."""
    c = conversations
    rows = c.where(c["conv_id"].isNotNull()).select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), *[F.coalesce(c[x].cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    code = F.crc32(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" "))).cast("binary")) % 20
    times = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    coded = rows.withColumn("code", code)
    return coded.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times)).alias("copy")).drop("copy")


def repaired(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every id of ``conversations``: figures and digest of its ``rows``; zeros and empty strings' digests where none are left."""
    found, pieces = repair(rows)
    ids = conversations.where(conversations["conv_id"].isNotNull()).select(conversations["conv_id"].cast("long").alias("conv_id")).distinct()
    full = ids.join(found.join(digests(pieces), "conv_id"), "conv_id", "left")
    return full.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"]).na.fill(hashlib.sha256(b"").hexdigest(), ["repaired_sha256"])
