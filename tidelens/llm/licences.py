"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates their expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelens.llm.shared import pieces
from tidelens.llm.words import LOWER

# The phrases every scan reports, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, by their words.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
# Families of licence identifiers, by their first part.
FAMILIES = {
    "gpl": "gpl",
    "lgpl": "lgpl",
    "agpl": "agpl",
    "apache": "apache",
    "mit": "mit",
    "bsd": "bsd",
    "0bsd": "bsd",
    "isc": "isc",
    "mpl": "mpl",
    "epl": "epl",
    "bsl": "bsl",
    "cc0": "cc0",
    "unlicense": "unlicense",
}
TAG = "spdx license identifier"
TAG_TEXT = re.compile(rb"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)")
#: Other than letters and digits of ASCII and all beyond it: between words.
_SPACED = bytes(b if (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) else 32 for b in LOWER)
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: What each kind of evidence is worth; a tag is worth what its expression evaluates to.
PHRASE_SCORE, NOTICE_SCORE, UNKNOWN_SCORE, BROKEN_SCORE = 0.9, 0.7, 0.5, 0.25

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def label_of(identifier: str) -> tuple[str, float]:
    """Label and worth of a licence identifier; unknown ones keep their own name."""
    name = identifier.rstrip("+")
    if name.startswith("cc-by"):
        return re.sub(r"-\d.*$", "", name), 1.0
    family = FAMILIES.get(name.partition("-")[0])
    return (family, 1.0) if family else (name, UNKNOWN_SCORE)


def postfix(expression: str) -> list[str] | None:
    """The expression's parts in postfix order by the shunting-yard method; None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # an operand or an opening parenthesis comes next
    for part in re.findall(r"[()]|[^\s()]+", expression):
        if part == "(":
            if not operand:
                return None
            held.append(part)
        elif part == ")":
            if operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif part in PRECEDENCE:
            if operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[part]:
                out.append(held.pop())
            held.append(part)
            operand = True
        else:
            if not operand or not re.fullmatch(r"[a-z0-9.+:-]*[a-z0-9][a-z0-9.+:-]*", part):
                return None
            out.append(part)
            operand = False
    if operand or "(" in held:
        return None
    return out + held[::-1]


def evaluate(expression: str) -> tuple[set[str], float] | None:
    """Labels and worth: `and` is worth its weaker side, `or` its stronger side; `with` adds the exception's name to the left side."""
    parts = postfix(expression)
    if parts is None:
        return None
    stack: list[tuple[set[str], float, str]] = []
    for part in parts:
        if part not in PRECEDENCE:
            label, worth = label_of(part)
            stack.append(({label}, worth, part))
            continue
        (right, worth2, name), (left, worth1, _) = stack.pop(), stack.pop()
        if part == "with":
            if not name or len(right) != 1:
                return None
            stack.append((left | {name}, worth1, ""))
        else:
            stack.append((left | right, (min if part == "and" else max)(worth1, worth2), ""))
    return stack[0][0], stack[0][1]


def expression_of(rest: bytes) -> str:
    """The expression at the head of what follows a tag: it ends before the first part that cannot belong to it."""
    taken: list[str] = []
    depth, operand = 0, True
    for part in re.findall(r"[()]|[^\s()]+", rest.decode("utf-8", "replace")):
        word = part.rstrip(".,;*/\"'>") if part not in "()" else part
        if part == "(" and operand:
            depth += 1
        elif part == ")" and not operand and depth:
            depth -= 1
        elif word in PRECEDENCE and not operand:
            operand = True
        elif operand and word and word not in "()":
            operand = False
        else:
            break
        taken.append(word)
        if word != part:
            break
    return " ".join(taken)


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan(text: bytes, phrases: ahocorasick.Automaton) -> tuple:
    """Everything of the result but the id, for one whole text."""
    words = text.translate(_SPACED).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places, base, labels, score = [], set(), set(), 0.0
    tagged = False
    for end, (kind, label, size) in phrases.iter(joined):
        if kind == "tag":
            tagged = True
            continue
        labels.add(label)
        score = max(score, PHRASE_SCORE if kind == "base" else NOTICE_SCORE)
        if kind == "base":
            base.add(label)
            places.append(end - size + 1)
    counted = at = 0  # words before `at`
    starts = []
    for p in sorted(places):
        counted += joined.count(" ", at, p)
        at = p
        starts.append(counted)
    if tagged:
        for m in TAG_TEXT.finditer(text.translate(LOWER)):
            value = evaluate(expression_of(m[1]))
            score = max(score, BROKEN_SCORE if value is None else value[1])
            labels |= set() if value is None else value[0]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def licence_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with an id: words, places of base phrases, labels and a score from 0 (no sign of a licence) to 1.

    Null and empty texts have no words, no labels ('') and score 0.  Phrases may overlap; each place counts.  A tag whose expression
    is malformed gives no label and a score of ``BROKEN_SCORE``.  Repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.float64() if c.endswith("double") else pa.int64() for c in SCHEMA.split(", ")]
        for texts, rows in pieces(batches):
            columns = zip(*(scan(t, phrases) for t in texts), strict=True)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return named.where("doc_id is not null").mapInArrow(run, SCHEMA)
