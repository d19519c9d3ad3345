"""Byte-pair encoding and decoding of whole texts; long texts are encoded in parts and put together by tree concatenation.

A long text is cut into leaves, which any executor encodes.  Neighbours are joined pair by pair: the text of a few tokens on either side
of the join is encoded anew, and the window grows until the new tokens begin with the left side's and end with the right side's.
Adjacent tokens of a right encoding stay right whatever stands further away, so a join that agrees on both sides is exact; a window
that has grown over both sides is exact anyway.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.llm.shared import PIECE, partitions, pieces

#: Bytes from which a text is cut into leaves, and characters of a leaf.
LONG, LEAF = 1 << 16, 1 << 15
#: Tokens on either side of a join that are encoded anew at first, and that have to agree at either end.
WINDOW, AGREE = 16, 4

# Fixed value: how byte-level vocabularies split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model, split = told["model"], told["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or told["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError("added tokens that take their surroundings along are not supported")
        ranks = {bytes(alphabet[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        joined = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(joined, joined[1:])):
            raise ValueError("ids must follow the order of the merges")
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.bytes = [b""] * (max([*ranks.values(), *special.values()]) + 1)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in special.items())]:
            self.bytes[i] = token

    def encode(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype(np.int32)

    def raw(self, ids: np.ndarray) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()])

    def decode(self, ids: np.ndarray) -> str:
        """The text of the tokens; bytes that are no UTF-8 become U+FFFD."""
        return self.raw(ids).decode("utf-8", "replace")

    def _opens(self, token: int) -> bool:
        """Does the token begin with the first byte of a character?"""
        return self.bytes[token][0] & 0xC0 != 0x80

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts put together, from their encodings."""
        if not len(left) or not len(right):
            return left if len(left) else right
        n = WINDOW
        while True:
            a, b = min(n, len(left)), min(n, len(right))
            while a < len(left) and not self._opens(left[-a]):
                a += 1
            while b < len(right) and not self._opens(right[b]):
                b += 1
            old_left, old_right = left[len(left) - a :], right[:b]
            new = self.encode((self.raw(old_left) + self.raw(old_right)).decode("utf-8"))
            m = min(AGREE, len(new))
            begins = a == len(left) or (a >= m and (new[:m] == old_left[:m]).all())
            ends = b == len(right) or (b >= m and (new[len(new) - m :] == old_right[b - m :]).all())
            if begins and ends:
                return np.concatenate([left[: len(left) - a], new, right[b:]])
            n *= 2

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        """The encoding of many texts put together, joined as a balanced tree."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else np.empty(0, np.int32)


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each worker and file."""
    return Codec(path)


def leaves(text: str, size: int = LEAF) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *arrays]), pa.int32()))


ENCODED = "doc_id long, ids array<int>, decoded string"


def encode_decode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG, leaf_chars: int = LEAF
) -> DataFrame:
    """doc_id, ids (the whole text's tokens) and decoded (the text they give) of every document with an id.

    Null and empty texts have no tokens and decode to ''.  Repeated rows give repeated results.  ``path`` is a vocabulary file that every
    executor has.  Texts of over ``long_bytes`` are cut into leaves of ``leaf_chars``, which are dealt over all executors.
    """
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    named = named.where("doc_id is not null")

    def result(c: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, _lists(ids), pa.array([c.decode(i) for i in ids], pa.string())], ["doc_id", "ids", "decoded"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for texts, rows in pieces(batches):
            yield result(c, rows.column(0), [c.encode(t.decode("utf-8")) for t in texts])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, rows in pieces(batches, limit=1):
            for t, doc, row in zip(texts, rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True):
                parts = leaves(t.decode("utf-8"), leaf_chars)
                for i in range(0, len(parts), 64):
                    some = parts[i : i + 64]
                    n = len(some)
                    numbers = [pa.array([doc] * n, pa.int64()), pa.array([row] * n, pa.int64()), pa.array(range(i, i + n), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(some, pa.string())], ["doc_id", "row", "leaf", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for texts, rows in pieces(batches, 3, PIECE):
            ids = pa.array([c.encode(t.decode("utf-8")).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*rows.columns[:3], ids], ["doc_id", "row", "leaf", "ids"])

    def join(group: pa.Table) -> pa.Table:
        c = codec(path)
        parts = group.sort_by("leaf").column("ids").to_pylist()
        ids = c.concatenate([np.frombuffer(p, np.int32) for p in parts])
        return pa.Table.from_batches([result(c, group.column("doc_id").combine_chunks()[:1], [ids])])

    short = named.where(F.octet_length("text") <= long_bytes).mapInArrow(whole, ENCODED)
    spark = docs.sparkSession
    long = (
        named.where(F.octet_length("text") > long_bytes)
        .withColumn("row", F.monotonically_increasing_id())
        .mapInArrow(cut, "doc_id long, row long, leaf int, text string")
        .repartition(partitions(spark), "row", "leaf")
        .mapInArrow(encode, "doc_id long, row long, leaf int, ids binary")
        .groupBy("row")
        .applyInArrow(join, ENCODED)
    )
    return short.unionByName(long)
