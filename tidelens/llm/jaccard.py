"""N-gram Jaccard join: documents of similar word shingles, found group by group with a token-group matrix.  Exact at every size.

* Documents of one shingle set form a class; the work below is done once for each class.
* Tokens (shingles) have one order for all: the most frequent ones last, else by hash.  Of two sets of similarity t, each shares at least
  l tokens of its first n - ceil(t n) + l with such a prefix of the other, so only these prefixes are dealt out.
* Of its prefix tokens that other classes have too, each class then leaves out the l - 1 most widespread.  One shared token remains in both
  all the same, and what only a common passage shares is mostly gone.
* Classes that meet in a prefix are compared with a neighbour first; what links becomes one group.  A few such rounds, each linear in the
  prefixes, join the members of large families without forming their pairs.
* The token-group matrix holds the prefix tokens that are left, with the classes that have them and their groups.  A class meets those of
  foreign groups that share a token, have a fitting size and a fitting sketch: the parities of a set's tokens in 1,024 places.  A place
  where two sketches differ holds a token that only one of the sets has, so sets whose sketches differ in more places than similar sets
  differ in tokens cannot link.  What is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelens.llm.graph import components
from tidelens.llm.shared import bits_set, in_table, membership, pieces, saved
from tidelens.llm.words import U64, distinct, hashes, mix, shingles, tokens

#: The similarity, as a fraction; tokens of a shingle; tokens put last (bounds a broadcast); rounds in which neighbours are compared; classes
#: of one token that are put in a row there.
OVER, OF, SIZE, FREQUENT, ROUNDS, ROW = 3, 4, 5, 1 << 17, 4, 4096
#: Columns of a sketch, 64 places each.
SKETCH = [f"s{j}" for j in range(16)]


def sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text and value, their texts' numbers, and each text's set size and class (a hash of the whole set)."""
    buf, starts, lengths, text = tokens(texts)
    v, owner = distinct(*shingles(hashes(buf, starts, lengths), text, len(texts), SIZE))
    n = np.bincount(owner, minlength=len(texts))
    total = np.zeros(len(texts), U64)
    if len(v):
        total[n > 0] = np.add.reduceat(mix(v * U64(0xC2B2AE3D27D4EB4F)), np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]))
    return v, owner, n, mix(total + n.astype(U64)).view(np.int64)


def least_overlap(n):
    """Tokens that a set of ``n`` shares with any set as similar as asked: ceil(t n)."""
    return (OVER * n + OF - 1) // OF


def shared_tokens(n):
    """Tokens of the prefix that similar sets share: grows no faster than ``least_overlap``, as the guarantee for unequal sizes needs."""
    return 1 + least_overlap(n) // 9


def sketches(v: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text the parities of its tokens in 64 places a column."""
    out = np.zeros((texts, len(SKETCH)), U64)
    np.bitwise_xor.at(out, (owner, ((v >> U64(6)) % U64(len(SKETCH))).astype(np.int64)), U64(1) << (v & U64(63)))
    return out


def _firsts(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_index=True)[1]


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts, rows in pieces(batches):
        _, _, n, cls = sets(texts)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cls), pa.array(n.astype(np.int64))], ["doc_id", "cls", "n"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that several classes of one piece share."""
    for texts, _ in pieces(batches):
        v, owner, _, cls = sets(texts)
        first = np.zeros(len(texts), bool)
        first[_firsts(cls)] = True
        t, c = np.unique(v[first[owner]], return_counts=True)
        t, c = t[c > 1], c[c > 1]
        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "c"])


def _prefixes(last: np.ndarray):
    """Function for mapInArrow: prefix tokens of each class of a piece; ``last`` are the sorted tokens that come last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, _ in pieces(batches):
            v, owner, n, cls = sets(texts)
            first = np.zeros(len(texts), bool)
            first[_firsts(cls)] = True
            v, owner = v[first[owner]], owner[first[owner]]
            frequent = np.zeros(len(v), bool)
            if len(last):
                frequent = last[np.minimum(np.searchsorted(last, v), len(last) - 1)] == v
            order = np.lexsort((v, frequent, owner))
            v, owner, frequent = v[order], owner[order], frequent[order]
            begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, int)
            place = np.arange(len(v)) - np.repeat(begins, np.diff(np.r_[begins, len(v)]))
            keep = place < (n - least_overlap(n) + shared_tokens(n))[owner]
            v, owner = v[keep], owner[keep]
            columns = [v.view(np.int64), cls[owner], n[owner].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "cls", "n"])

    return run


def _packed(wanted):
    """Function for mapInArrow: class, compressed text and sketch of each document (id, text, hash of the id) that the table ``wanted`` lets through.

    A compressed text takes less than half of what its shingles' hashes do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            b = b.filter(pa.array(bits_set(wanted.value, b.column(2).to_numpy().view(U64))))
            for texts, _ in pieces(iter([b])):
                v, owner, _, cls = sets(texts)
                marks = sketches(v, owner, len(texts)).view(np.int64).T
                columns = [pa.array(cls), pa.array([pack.compress(t) for t in texts], pa.binary()), *(pa.array(np.ascontiguousarray(m)) for m in marks)]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "packed", *SKETCH])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, packed texts of both) whose sets are similar enough."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            b = batch.slice(i, 64)
            texts = [unpack.decompress(t.as_buffer()) for k in (2, 3) for t in b.column(k)]
            v, _, n, _ = sets(texts)
            cuts = np.r_[0, np.cumsum(n)]
            keep = []
            for j in range(b.num_rows):
                x, y = (v[cuts[k] : cuts[k + 1]] for k in (j, j + b.num_rows))
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(OF * both >= OVER * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _compatible(n: str, m: str) -> Column:
    return (OF * F.col(n) >= OVER * F.col(m)) & (OF * F.col(m) >= OVER * F.col(n))


def _alike(n: str, m: str, one: str, two: str) -> Column:
    """Can sets of ``n`` and ``m`` tokens link whose sketches have these prefixes?  They differ in (1 - t) / (1 + t) of n + m tokens at most."""
    apart = sum((F.bit_count(F.col(one + s).bitwiseXOR(F.col(two + s))) for s in SKETCH), F.lit(0))
    return (OF + OVER) * apart <= (OF - OVER) * (F.col(n) + F.col(m))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest id reachable over similar documents) for every document with an id.

    Null and wordless texts have no shingles and link with nothing.  Repeated rows are reported each; rows of one id are one node of the
    graph.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).where("doc_id is not null")
    base = saved(named.mapInArrow(_classes, "doc_id long, cls long, n long"), "classes")
    first = base.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"))

    common = named.mapInArrow(_frequent, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    common = common.orderBy(F.desc("c"), "token").limit(frequent).select("token").toArrow().column(0).to_numpy()
    last = np.sort(common.view(U64))

    # prefix tokens that another class has too, without each class's most widespread ones
    met, row = Window.partitionBy("token"), Window.partitionBy("token").orderBy("n", "cls")
    runs = named.mapInArrow(_prefixes(last), "token long, cls long, n int").select(
        "*", F.min("cls").over(met).alias("lo"), F.max("cls").over(met).alias("hi"), F.count("*").over(met).alias("df"), F.lag("cls").over(row).alias("same")
    )
    runs = runs.where((F.col("lo") < F.col("hi")) & (F.col("same").isNull() | (F.col("same") != F.col("cls")))).select("token", "cls", "n", "df")
    widespread = F.row_number().over(Window.partitionBy("cls").orderBy(F.desc("df"), "token"))
    runs = runs.withColumn("w", widespread).where(F.col("w") >= 1 + F.floor(F.floor((OVER * F.col("n") + OF - 1) / OF) / 9)).drop("w")
    runs = saved(runs, "prefixes")

    wanted = first.join(runs.select("cls").distinct(), "cls").select("first")
    table = spark.sparkContext.broadcast(membership(wanted))
    texts = saved(named.withColumn("at", F.xxhash64("doc_id")).mapInArrow(_packed(table), "cls long, packed binary, " + ", ".join(f"{s} long" for s in SKETCH)), "texts")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Which of the pairs (a, b) link?"""
        pairs = saved(pairs, "pairs")
        ends = spark.sparkContext.broadcast(membership(pairs.select("a").union(pairs.select("b")).distinct()))
        some = texts.select("cls", "packed").where(in_table(ends, F.xxhash64("cls")))
        one, two = some.toDF("a", "x"), some.toDF("b", "y")
        full = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
        return saved(full.mapInArrow(_compared, "a long, b long").distinct(), name)

    def best(counted: DataFrame) -> DataFrame:
        """For each class the two neighbours it shares most with."""
        either = counted.union(counted.select("b", "a", "c")).toDF("a", "b", "c").groupBy("a", "b").agg(F.sum("c").alias("c"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))
        chosen = either.withColumn("rank", rank).where("rank <= 2")
        return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    classes = saved(runs.select("cls").distinct(), "prefix-classes")
    groups, links = classes.select("cls", F.col("cls").alias("g")), None
    for r in range(ROUNDS + 1):
        if links is not None:
            merged = components(links)
            groups = classes.join(merged, classes["cls"] == merged["id"], "left").select("cls", F.coalesce("component", "cls").alias("g"))
        # only tokens of several groups are still of use
        placed = runs.select("token", "cls", "n", "df").join(groups, "cls")
        met = Window.partitionBy("token")
        placed = placed.select("*", F.min("g").over(met).alias("lo"), F.max("g").over(met).alias("hi")).where("lo < hi").drop("lo", "hi")
        runs = placed = saved(placed, "groups")
        if r == ROUNDS:
            break
        part = F.pmod(F.xxhash64("cls", F.lit(r)), 1 + F.floor(F.col("df") / ROW))
        row = Window.partitionBy("token", "part").orderBy("n" if r == 0 else F.xxhash64("cls", F.lit(r)), "cls")
        nearby = placed.withColumn("part", part).select(
            F.col("cls").alias("a"), "n", "g", F.lead("cls").over(row).alias("b"), F.lead("n").over(row).alias("m"), F.lead("g").over(row).alias("k")
        )
        nearby = nearby.where((F.col("g") != F.col("k")) & _compatible("n", "m")).groupBy("a", "b").agg(F.count("*").alias("c"))
        new = linked(best(nearby), f"links-{r}")
        links = new if links is None else links.union(new)
        if not new.limit(1).count():
            break  # no two neighbours of different groups link any more

    left = spark.sparkContext.broadcast(membership(placed.select("cls").distinct()))
    marks = texts.where(in_table(left, F.xxhash64("cls"))).select("cls", *SKETCH).dropDuplicates(["cls"])
    matrix = saved(placed.select("token", "cls", "n", "g").join(marks, "cls"), "matrix")
    asked = matrix.select("token", F.col("cls").alias("a"), "n", "g", *(F.col(s).alias("x" + s) for s in SKETCH))
    members = matrix.select("token", F.col("cls").alias("b"), F.col("n").alias("m"), F.col("g").alias("k"), *(F.col(s).alias("y" + s) for s in SKETCH))
    met = asked.join(members, "token").where((F.col("g") < F.col("k")) & _compatible("n", "m") & _alike("n", "m", "x", "y"))
    pairs = met.select("a", "b").distinct()
    links = links.union(linked(pairs, "links-last"))

    # from classes to documents: equal sets link, rows of one id are one node
    of_class = base.where("n > 0").select("doc_id", "cls").join(first, "cls")
    ends = first.select("cls", "first")
    far = links.join(ends.toDF("a", "x"), "a").join(ends.toDF("b", "y"), "b").select("x", "y")
    whole = components(of_class.where("doc_id <> first").select("doc_id", "first").union(far).toDF("a", "b"))
    return (
        base.join(whole, base["doc_id"] == whole["id"], "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )

