"""A corpus pipeline of five stages; each reads what the one before it wrote.

toxicity -> line dedup -> MinHash near-dedup -> mixing -> SentencePiece. Every stage takes
(spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import lines, minhash, mixing, pieces, toxicity
from quillon.llm.common import Scratch, table
from quillon.llm.queries import CATEGORIES, PIECES_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the chain's last category does not reject."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.score(docs.select(*COLUMNS), chain, "toxic").where("not rejected").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document before them holds; n_chars follows the text."""
    kept = lines.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "lines"))
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows are told apart by doc_id and text. Rows alike in both are copies as well, and one stays;
    rows without doc_id or words stay.
    """
    scratch = Scratch(spark, "minhash")
    groups = scratch.save(minhash.near_duplicate_rows(docs, scratch).where("doc_id is not null and n_shingles > 0").groupBy("doc_id", "tkey").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"))
    rows = docs.select(*COLUMNS).withColumn("tkey", F.xxhash64(F.col("text").cast("string")))
    key = ["doc_id", "tkey"]
    once = rows.join(groups.select(*key), key, "left_anti")
    several = rows.join(groups.where("stays").select(*key), key, "left_semi").dropDuplicates(key)
    return once.unionByName(several).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document as many times as its source's target asks for, three at most."""
    return mixing.mixed_rows(docs.select(*COLUMNS), Scratch(spark, "mix")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens and the piece ids of every row of the mix."""
    out = pieces.encode(docs.select("doc_id", "source", "lang", "text"), pieces.read_model(PIECES_MODEL), Scratch(spark, "pieces"))
    return out.select("doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL has no trained classifier and no best segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again as the next one's docs.

    What a stage wrote for itself is deleted once its result is written, and so is the stage's input.
    """
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        mark, before = len(Scratch.made), docs
        docs = scratch.save(stage(spark, before, sf_dir))
        Scratch.free_since(spark, mark)
        scratch.free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
