"""The registered query of each operator: production parameters, whole tables, the columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm import decontaminate, extract, language, lm, neighbours, packing, pieces, pii, quality, search, sharding, simhash, variants
from docketflow.plans.catalog import Catalog, read

CATALOG = Catalog()


@CATALOG.query("op1_sharding")
def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``: shard sizes at most one apart.

    The documents themselves are shuffled and written; sizes and digests are those of the files.
    """
    docs = read(spark, folder, "documents")
    sharded = sharding.shard_records(docs.withColumn("size", sharding.text_size(F.col("text"))), ["doc_id", "text"], "size")
    text = F.col("text")
    return sharding.stored_shards(sharded).select(
        "doc_id", sharding.text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@CATALOG.query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(read(spark, folder, "documents").select("doc_id", "text"))


@CATALOG.query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    return quality.quality_scores(read(spark, folder, "documents"), read(spark, folder, "labels"))


@CATALOG.query("op8_approximate_neighbours")
def op8_approximate_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors found for every vector whose id is divisible by 100."""
    return neighbours.nearest(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@CATALOG.query("op9_pii")
def op9_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: base spans counted and digested, all spans listed."""
    return pii.find(read(spark, folder, "documents"))


@CATALOG.query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by the conditional random field."""
    return language.identify(read(spark, folder, "documents"))


@CATALOG.query("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract(read(spark, folder, "pages"))


@CATALOG.query("op7_benchmark_decontamination")
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a copied or edited benchmark item."""
    return decontaminate.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@CATALOG.query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document under the hidden Markov model and under the base model."""
    return lm.score_documents(read(spark, folder, "documents"))


@CATALOG.query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Sampled pieces of every document, with the check that they decode to it."""
    return pieces.encode_documents(read(spark, folder, "documents"))


@CATALOG.query("op13_packed_ids")
def op13_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as token ids in files of fixed-width fields, read back: place, number and digest of each one's ids."""
    import public_tokenizers

    vocabulary = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.documents_of(packing.write_packed(read(spark, folder, "documents"), vocabulary))


_SMALL, _GREAT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_GREAT}', '{_SMALL}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_OP12 = f"""
WITH whole AS MATERIALIZED (SELECT row_number() OVER () AS doc, doc_id, {_TERMS} AS terms FROM documents),
     asked AS MATERIALIZED (SELECT row_number() OVER () AS item, item_id, {_TERMS} AS terms FROM benchmark),
     wanted AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(terms) AS term FROM asked) GROUP BY ALL),
     size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM whole WHERE len(terms) > 0),
     held AS (SELECT doc, doc_id, n, term, count(*) AS tf
              FROM (SELECT doc, doc_id, len(terms) AS n, unnest(terms) AS term FROM whole) WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
     weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, size GROUP BY term, docs),
     adds AS (SELECT doc, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // all_terms))) AS part
              FROM held JOIN weights USING (term), size),
     scores AS (SELECT item, item_id, doc, doc_id, sum(times * part)::BIGINT AS score
                FROM wanted JOIN adds USING (term) GROUP BY ALL HAVING sum(times * part) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST, doc)::INT AS rank, doc_id, score
FROM scores QUALIFY rank <= 10
"""


@CATALOG.query("op12_ranked_search", _OP12)
def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that score best for each benchmark item, by pipelined term partitioning."""
    return search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


_OP11 = f"""
WITH RECURSIVE
     eights AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs),
     runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\u00C0-\u00FF]{{7,}}')), '{_GREAT}', '{_SMALL}') AS run FROM documents),
     counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
     hashed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))),
                lambda a, b: xor(a >> 8, crcs[xor(a, b) % 256 + 1])), 4294967295::BIGINT) AS h FROM counted, eights),
     written AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
     words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     places AS (SELECT word, n, unnest(range(length(word)))::BIGINT AS spot FROM words),
     masked AS MATERIALIZED (SELECT word, n, spot, substr(word, 1, spot) AS head, substr(word, spot + 2) AS tail FROM places),
     near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b USING (head, tail) WHERE a.word <> b.word
              UNION SELECT a.word, b.word, b.n FROM masked a JOIN words b ON b.word = a.head || a.tail
              UNION SELECT b.word, a.word, a.n FROM masked a JOIN words b ON b.word = a.head || a.tail),
     best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word),
     stated AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
                CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best USING (word)),
     steps AS (SELECT word, word AS root FROM stated UNION ALL
               SELECT s.word, t.form FROM steps s JOIN stated t ON t.word = s.root WHERE t.form IS NOT NULL)
SELECT stated.word, stated.n, stated.n_near, stated.form, stated.form_n, root
FROM stated JOIN steps ON steps.word = stated.word JOIN stated AS ends ON ends.word = root WHERE ends.form IS NULL
"""


@CATALOG.query("op11_spelling_variants", _OP11)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word with its near words, its form and its root, by Bloom-guided neighbourhoods."""
    return variants.group_variants(read(spark, folder, "documents"))
