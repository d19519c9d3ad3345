import re

import numpy as np

from tidelens.llm.sentences import ALONE, SENTENCES, WORDS, without_repeated_sentences

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text):
    """Sentences as lists of (word, byte), straight from the definition."""
    b = (text or "").encode()
    out = [[]]
    words = list(WORD.finditer(b))
    for k, m in enumerate(words):
        out[-1].append((bytes(x + 32 if 65 <= x <= 90 else x for x in m[0]), m.start()))
        gap = b[m.end() : words[k + 1].start()] if k + 1 < len(words) else b""
        if m[0][-1:] in (b".", b"!", b"?") or b"\n" in gap or b"\r" in gap:
            out.append([])
    return [s for s in out if s], b


def brute(rows):
    texts = [(i, *split(t)) for i, t in rows]
    runs, first = [], {}
    for r, (i, sentences, _) in enumerate(texts):
        for k in range(len(sentences)):
            words, last = [], None
            for m in range(k, len(sentences)):
                words += [w for w, _ in sentences[m]]
                if (m - k + 1 >= SENTENCES and len(words) >= WORDS) or (m == k and len(words) >= ALONE):
                    last = m
                    break
            if last is not None:
                key = tuple(words)
                runs.append((r, i, k, last, key))
                first[key] = min(first.get(key, (i, k)), (i, k))
    gone = {}
    for r, i, k, last, key in runs:
        if first[key] < (i, k):
            gone.setdefault(i, set()).update(range(k, last + 1))
    out = []
    for i, sentences, b in texts:
        cuts = [s[0][1] for s in sentences] + [len(b)]
        hit = {k for k in gone.get(i, ()) if k < len(sentences)}
        kept = (b[: cuts[0]] if sentences else b) + b"".join(b[cuts[k] : cuts[k + 1]] for k in range(len(sentences)) if k not in hit)
        out.append((i, len(sentences), len(hit), kept.decode()))
    return sorted(out)


def test_against_all_runs(make_docs):
    rng = np.random.default_rng(5)
    vocabulary = ["wort%d" % i for i in range(300)]

    def sentence():
        return " ".join(rng.choice(vocabulary, int(rng.integers(1, 16)))) + str(rng.choice([".", "!", "?", ".\n", "\n", ". "])) + " "

    passages = ["".join(sentence() for _ in range(8)) for _ in range(4)] + [" ".join(rng.choice(vocabulary, 45)) + ". "]
    rows = []
    for i in range(50):
        text = ""
        for p in passages:
            text += "".join(sentence() for _ in range(int(rng.integers(0, 4))))
            if rng.random() < 0.3:
                text += p.upper() if rng.random() < 0.3 else p
        rows.append((int(i * 7 % 53), text))
    got = without_repeated_sentences(make_docs(rows)).collect()
    want = brute(rows)
    assert sum(r[2] for r in want) > 100
    assert sorted(map(tuple, got)) == want


def test_odd_rows(odd, odd_rows, nothing):
    assert sorted(map(tuple, without_repeated_sentences(odd).collect())) == brute(odd_rows)
    assert without_repeated_sentences(nothing).count() == 0


def brute_all(rows):
    """Removed sentences of every row when all runs count, however long."""
    texts = [(i, [[w for w, _ in s] for s in split(t)[0]]) for i, t in rows]
    runs, first = [], {}
    for i, sentences in texts:
        for k in range(len(sentences)):
            words = ()
            for m in range(k, len(sentences)):
                words += tuple(sentences[m])
                if (m > k and m - k + 1 >= SENTENCES and len(words) >= WORDS) or (m == k and len(words) >= ALONE):
                    runs.append((i, k, m, words))
                    first[words] = min(first.get(words, (i, k)), (i, k))
    gone = {i: set() for i, _ in texts}
    for i, k, m, words in runs:
        if first[words] < (i, k):
            gone[i].update(range(k, m + 1))
    return sorted((i, len(s), len(gone[i])) for i, s in texts)


def test_ends_of_repeated_passages_go_too(make_docs):
    rng = np.random.default_rng(6)
    number = iter(range(10**6))

    def sentence(n):
        return " ".join("w%d" % next(number) for _ in range(n)) + ". "

    block = sentence(15) + sentence(15) + sentence(3)  # 33 words: only the end's run holds the third sentence
    passages = ["".join(sentence(int(rng.integers(1, 16))) for _ in range(8)) for _ in range(4)]
    rows = [(i, sentence(30) + block + sentence(30)) for i in (1, 2)]
    rows += [(10 + i, "".join(sentence(5) + p for p in passages if rng.random() < 0.4) + sentence(9)) for i in range(30)]
    rows.append((50, block + block))
    got = sorted(tuple(r)[:3] for r in without_repeated_sentences(make_docs(rows), ends=True).collect())
    assert got == brute_all(rows)
    assert got[1] == (2, 5, 3)
