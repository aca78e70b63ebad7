"""From raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns documents; its result is written
as Parquet in the shared folder and read again by the next.  All but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushtext.llm.common import saved, table
from hushtext.llm.ngram_join import numbered_rows, row_classes
from hushtext.llm.personal_data import masker, train_spans
from hushtext.llm.sentence_pieces import load_model, piece_encoder
from hushtext.llm.source_mix import MixTarget, mix_sources
from hushtext.llm.toxicity import train_toxicity

# no document is left out; small sources are repeated by up to a quarter
MIX = MixTarget(max_repeats=1.25, budget="cover")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; empty ones stay."""
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.where(model.scorer()("text") < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: five words, 0.8 or more.

    It is the one of the smallest id, null last; of rows with the same id the one whose
    text has the smallest hash, of rows alike in both any one.  So a row that is repeated
    whole stays once, and a repeated or null id loses no text.  Texts without a word stay.
    """
    row, least = "near_row", "near_least"
    while {row, least} & set(docs.columns):
        row, least = row + "_", least + "_"
    rows = numbered_rows(docs, row)
    classes = row_classes(rows, 5, (4, 5), row=row).withColumnRenamed("row", row)
    placed = rows.select(row, "doc_id", F.xxhash64("text").alias("text_hash")).join(classes, row)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", row)
    first = placed.where("n_shingles > 0").groupBy("root").agg(F.min(order).alias(least))
    kept = first.select(F.col(f"{least}.{row}").alias(row))
    kept = kept.union(placed.where("n_shingles = 0").select(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked; ``n_chars`` follows the text."""
    mask = masker(train_spans(docs))
    return docs.withColumn("text", mask("text")).withColumn(
        "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)
    )


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each as often as the mix of sources asks for."""
    mixed = mix_sources(docs, MIX)
    copies = F.expr("sequence(1, mix_copies)")
    return (
        mixed.where("mix_copies > 0").withColumn("mix_copy", F.explode(copies)).select(docs.columns)
    )


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids."""
    encode = piece_encoder(spark, load_model())
    found = docs.withColumn("encoded", encode("text"))
    return found.select("doc_id", "lang", "source", "n_chars", "encoded.*")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("source_mix", mix_to_weights),
    ("sentence_pieces", encode_pieces),
]

# classifiers, hashing, graph search and piece merging cannot be put as SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
