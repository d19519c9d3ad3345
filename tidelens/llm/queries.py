"""The dealt operators as queries over the whole given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import bpe, conversations, decontam, filteraudit, jaccard, langid, licences, pitmanyor, ruleensemble, sentences, suffixes, toxicity, vptree
from tidelens.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# The other operators learn, approximate, hash byte strings or evaluate expressions; tests hold them against brute force.
SQL["op5_minhash_containment"] = r"""WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
 UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
s AS (SELECT DISTINCT side, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS t FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY 1),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s i JOIN s d ON d.t = i.t AND d.side = 'd' WHERE i.side = 'i' GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM p JOIN n ON n.id = item_id WHERE 4 * n_shared >= 3 * n_item"""
SQL["op9_jaccard_token_groups"] = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, md5_number(unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS t FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS id, a AS reached FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached),
m AS (SELECT id, min(reached) AS component FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id"""

SQL["op11_filter_audit"] = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 2 * length(t) AS c,
 regexp_matches(t, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails,
 count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)),
s AS (SELECT o AS filter_order, step::INTEGER AS step, o[step] AS x, o[1:step - 1] AS done FROM p, range(1, 6) r(step) WHERE length(o) = 5),
g AS (SELECT part, filter_order, step, x, sum(CASE WHEN regexp_matches(fails, '[' || done || x || ']') THEN 0 ELSE n END)::BIGINT AS kept,
 sum(CASE WHEN contains(fails, x) AND (done = '' OR NOT regexp_matches(fails, '[' || done || '_]')) THEN n ELSE 0 END)::BIGINT AS removed,
 sum(CASE WHEN contains(fails, x) THEN n ELSE 0 END)::BIGINT AS failing, sum(CASE WHEN fails = x THEN n ELSE 0 END)::BIGINT AS unique_fails,
 sum(CASE WHEN contains(fails, x) AND (done = '' OR NOT regexp_matches(fails, '[' || done || '_]')) THEN good ELSE 0 END)::BIGINT AS good_lost,
 sum(CASE WHEN contains(fails, x) AND (done = '' OR NOT regexp_matches(fails, '[' || done || '_]')) THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM m, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, failing - removed AS redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, x))::BIGINT AS shapley FROM g"""


@query
def op1_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return vptree.nearest_neighbours(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0, k=20, slack=0.3)


@query
def op2_bpe_tree_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text's tokens and of what they decode to."""
    import public_tokenizers

    done = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _remainder(docs: DataFrame, n: int) -> Column:
    return F.crc32(docs["doc_id"].cast("string").cast("binary")) % n


@query
def op3_language_recurrent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned where the remainder of the id's checksum is not 1."""
    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.where(_remainder(docs, 3) != 1))
    found = langid.predict(docs, net)
    return found.select("doc_id", (_remainder(found, 3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op4_suffix_array_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without its repeated strings of 100 bytes."""
    done = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters or more of the shingles of a test item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_toxicity_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from labels where the remainder of the id's checksum is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = docs.where(_remainder(docs, 4) != 2).select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    found = toxicity.score(docs, toxicity.fit(taught))
    held_out = (_remainder(found, 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every text under a model of those where the remainder of the id's checksum is not 2."""
    docs = table(spark, sf_dir, "documents")
    found = pitmanyor.score(docs, _remainder(docs, 7) != 2)
    return found.select("doc_id", (_remainder(found, 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without runs of sentences that occur before."""
    done = sentences.without_repeated_sentences(table(spark, sf_dir, "documents"), ends=True)
    return done.select("doc_id", "n_sentences", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_jaccard_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are similar to 0.75."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query
def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, identifier tags and their expressions in every text."""
    return licences.licence_scan(table(spark, sf_dir, "documents"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five text filters remove in each of their orders, by source."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, and its lightest repair."""
    given = table(spark, sf_dir, "conversations")
    return conversations.repaired(given, conversations.damaged(given))


@query
def op13_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from labels where the remainder of the id's checksum is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    taught = docs.where(_remainder(docs, 4) != 2).select("doc_id", "text").join(labels.select("doc_id", "quality"), "doc_id")
    found = ruleensemble.score(docs, ruleensemble.fit(taught))
    held_out = (_remainder(found, 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= ruleensemble.THRESHOLD).cast("int").alias("predicted"))
