import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from tidelens.llm.bpe import Codec, encode_decode, leaves

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_concatenation_is_exact_whatever_the_cuts():
    rng = random.Random(3)
    codec = Codec(PATH)
    signs = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "ß", "日", "1", "23", "'s", "'re", "...", "<|endoftext|>", "<|", "|>", "́", "🙂", " ", "zzzzzzz", "     ", "\r\n", "'"]
    for _ in range(1500):
        some = rng.sample(signs, rng.choice([1, 2, 3, 6, 25]))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 250)))
        size = rng.choice([1, 2, 3, 7, 40, 100])
        assert codec.concatenate([codec.encode(x) for x in leaves(text, size)]).tolist() == library(text)


def test_long_text_without_a_break():
    codec = Codec(PATH)
    rng = random.Random(5)
    for text in ("a" * 50000, "ab" * 20000, "".join(rng.choice("abcdé") for _ in range(40000)), " " * 9000 + "x" + "\n" * 9000):
        assert codec.concatenate([codec.encode(x) for x in leaves(text, 1000)]).tolist() == library(text)


def test_documents(spark, odd, odd_rows, nothing):
    got = encode_decode(odd, PATH, long_bytes=100, leaf_chars=30).collect()
    want = sorted((i, library(t or ""), LIBRARY.decode(library(t or ""), skip_special_tokens=False)) for i, t in odd_rows)
    assert sorted((r["doc_id"], r["ids"], r["decoded"]) for r in got) == want
    assert encode_decode(nothing, PATH).count() == 0


def test_query_against_the_library(spark, sf):
    from tidelens.llm.queries import QUERIES
    from tidelens.llm.shared import table

    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op2_bpe_tree_concatenation"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
