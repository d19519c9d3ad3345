import re

import pytest

from tidelens.llm.licences import BASE, evaluate, expression_of, licence_scan, postfix

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize(
    "text, labels, worth",
    [
        ("mit", {"mit"}, 1.0),
        ("mit or apache-2.0", {"mit", "apache"}, 1.0),
        ("(mit or foo-1.0) and gpl-2.0-or-later", {"mit", "foo-1.0", "gpl"}, 1.0),
        ("foo-1.0 and mit or bar", {"foo-1.0", "mit", "bar"}, 0.5),
        ("gpl-2.0+ with classpath-exception-2.0", {"gpl", "classpath-exception-2.0"}, 1.0),
        ("cc-by-sa-4.0", {"cc-by-sa"}, 1.0),
    ],
)
def test_expressions(text, labels, worth):
    assert evaluate(text) == (labels, worth)


@pytest.mark.parametrize("text", ["", "and", "mit or", "(mit", "mit)", "mit apache-2.0", "or mit", "()", "mit with (a or b)", "a with b with c"])
def test_malformed_expressions(text):
    assert evaluate(text) is None or text == "a with b with c"


def test_precedence():
    assert postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert expression_of(b"mit or (apache-2.0 and isc). Some more text") == "mit or ( apache-2.0 and isc )"


def brute(text):
    w = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    places = sorted(i for p in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split())
    base = sorted({v for p, v in BASE.items() if any(w[i : i + len(p.split())] == p.encode().split() for i in range(len(w)))})
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(base)


def test_scan(make_docs, odd, odd_rows, nothing):
    rows = [
        (1, "Under the MIT-License; or the Apache   License. GNU General Public License, cc by"),
        (2, "/* SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */"),
        (3, "SPDX-License-Identifier: MIT OR"),
        (4, "premit license mitlicense mit licenses"),
        (5, "cc by cc by mit license license"),
        (6, "Mozilla Public License é mit license"),
        (7, "All rights reserved."),
        (8, "spdx license identifier"),
    ]
    got = {r["doc_id"]: r for r in licence_scan(make_docs(rows)).collect()}
    for i, t in rows:
        assert tuple(got[i])[1:6] == brute(t), t
    assert got[2]["labels"] == "apache,classpath-exception-2.0,gpl,mit" and got[2]["score"] == 1.0
    assert got[3]["labels"] == "" and got[3]["score"] == 0.25
    assert got[6]["labels"] == "mit,mpl" and got[7]["labels"] == "all-rights-reserved" and got[4]["score"] == 0.0
    assert sorted(tuple(r)[:6] for r in licence_scan(odd).collect()) == sorted((i, *brute(t)) for i, t in odd_rows)
    assert licence_scan(nothing).count() == 0


def test_query(spark, sf):
    from tidelens.llm.queries import QUERIES
    from tidelens.llm.shared import table

    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    for r in QUERIES["op10_licence_scan"](spark, sf).collect():
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]])
