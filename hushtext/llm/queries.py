"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.llm.chat_format import format_chats
from hushtext.llm.common import table
from hushtext.llm.exact_topk import quantised, top_k
from hushtext.llm.imatch import fingerprint_documents
from hushtext.llm.language_id import train_languages
from hushtext.llm.ngram_join import near_duplicate_classes
from hushtext.llm.periodic_runs import run_finder
from hushtext.llm.personal_data import span_report, train_spans
from hushtext.llm.ranked_search import rank_documents
from hushtext.llm.sentence_pieces import load_model, piece_encoder
from hushtext.llm.simhash_join import simhash_classes
from hushtext.llm.source_mix import MixTarget, mix_sources
from hushtext.llm.toxicity import train_toxicity
from hushtext.llm.url_filter import canonical_url, filter_urls

URL_RULES = {
    "net/": "block",
    "example.net/en/": "allow",
    "example.com/de/": "block",
    "org/fr/": "allow",
}
MIX = MixTarget(entropy=0.97, max_repeats=4.0)


def fold(doc_id: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def _held_out(folds: int, fold_number: int) -> Column:
    return F.coalesce(fold("doc_id", folds) == fold_number, F.lit(False))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by shingles of four words and an index of 0.85."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"), 4, (85, 100))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the weight of their source and their copies in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs, MIX).drop("text")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector with all others."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", quantised("embedding").alias("vector")
    )
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from three of four folds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_languages(docs.where(~_held_out(4, 2)))
    return docs.select(
        "doc_id", _held_out(4, 2).alias("held_out"), model.identifier()("text").alias("found")
    ).select(
        "doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.accepted"
    )


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether decoding restores it."""
    docs = table(spark, sf_dir, "documents")
    encode = piece_encoder(spark, load_model())
    return docs.select("doc_id", encode("text").alias("found")).select("doc_id", "found.*")


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered turn by turn."""
    return format_chats(table(spark, sf_dir, "conversations"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages judged by rules; the list holds URLs that were fetched repeatedly."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = (
        pages.select(canonical_url(F.col("url")).alias("canonical"))
        .groupBy("canonical").count().where("count > 1")
    )
    return filter_urls(pages, listed, URL_RULES)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from four of five folds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~_held_out(5, 0))
    model = train_toxicity(docs, labels)
    return docs.select(
        "doc_id", _held_out(5, 0).alias("held_out"), model.scorer()("text").alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    report = span_report(train_spans(docs))
    return docs.select("doc_id", report("text").alias("found")).select("doc_id", "found.*")


def op11_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents by fingerprints that differ in two bits at most."""
    found = simhash_classes(table(spark, sf_dir, "documents"))
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a part of them repeated to the end."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    hashed = F.crc32(doc_id.cast("string"))
    g = F.floor(hashed / 10)
    start = (g % F.nullif(n, F.lit(0))).cast("int")
    period = (1 + F.floor((n - start) / (3 + g % 8))).cast("int")
    times = F.ceil((n - start) / period).cast("int")
    loop = F.flatten(F.array_repeat(F.slice(words, start + 1, period), times))
    edited = F.concat(F.slice(words, F.lit(1), start), F.slice(loop, F.lit(1), n - start))
    return F.when((hashed % 10 == 0) & (n > 0), F.array_join(edited, " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words of every text, some of them edited, and the text without them."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", looped(F.col("doc_id"), F.col("text")).alias("text")
    )
    found = docs.select("doc_id", run_finder()("text").alias("found")).select("doc_id", "found.*")
    # runs come by start, then period; only a greater exponent replaces an earlier one
    best = F.expr(
        "aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), "
        "(b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period "
        "THEN r ELSE b END)"
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every item of the benchmark."""
    docs = table(spark, sf_dir, "documents")
    return rank_documents(docs, table(spark, sf_dir, "benchmark"))


_OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://')
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw,
    translate(regexp_extract(rest, '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, rest FROM cut
), tails AS (
  SELECT page_id, host, substr(rest, length(raw) + 1) AS tail FROM named
), parts AS (
  SELECT page_id, host, regexp_extract(tail, '^[^?#]*') AS path,
    regexp_replace(regexp_replace(regexp_extract(tail, '^[^?#]*\\?([^#]*)', 1),
      '(^|&)(ref|utm_[a-z]+)=[^&]*', '', 'g'), '^&+', '') AS query FROM tails
), spelled AS (
  SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '')
    || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END
    END AS canonical FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM spelled
), listed AS (
  SELECT canonical FROM spelled WHERE canonical IS NOT NULL
  GROUP BY canonical HAVING count(*) > 1
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join, op2_source_mix, op3_exact_topk, op4_language_id,
        op5_sentence_pieces, op6_imatch, op7_chat_format, op8_url_filter, op9_toxicity,
        op10_personal_data, op11_simhash_classes, op12_periodic_runs, op13_ranked_search,
    )
}

_OP3_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

_OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (
  SELECT item_id, term, count(*) AS times FROM items GROUP BY ALL
), whole AS (
  SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM docs WHERE len(terms) > 0
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(
    CAST(2 * (SELECT docs FROM whole) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted GROUP BY term
), scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf)
    // (1000 * tf + 12 * (100 - 25 + (25 * n * whole.docs) // whole.terms)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term), whole
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""

ORACLE_SQL = {
    "op3_exact_topk": _OP3_SQL,
    "op8_url_filter": _OP8_SQL,
    "op13_ranked_search": _OP13_SQL,
}
