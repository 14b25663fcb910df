"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents, which run() writes as Parquet and reads again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkspark.llm.bpe import encode
from walkspark.llm.common import stored, table, unused
from walkspark.llm.mixing import in_mix_order, mix
from walkspark.llm.neardup import drop_near_duplicates
from walkspark.llm.pii import redact
from walkspark.llm.quality import clean_lines


#: Columns that the operators add; a column of documents with such a name is set aside meanwhile.
ADDED = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept", "block", "row_in_block", "release", "deadline", "slot"}


def _documents(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """stage(docs) with the columns of docs and no others; n_chars, where there is one, is brought up to date."""
    clash = [c for c in docs.columns if c.lower() in ADDED]
    aside = dict(zip(clash, unused(docs, *clash)))
    made = stage(docs.withColumnsRenamed(aside)).select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that fail the base rules or lose too much go.

    Null, empty and short texts go; each row is judged alone and whole, so repeated rows share their fate and there are no
    ties. An empty table stays empty.
    """
    return _documents(docs, lambda df: clean_lines(df).filter("kept").withColumn("text", F.col("clean_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: the one with the smallest id.

    Null and empty texts are near nothing and stay; of rows that repeat an id one stays; rows with a null id stay all.
    Texts are compared whole. An empty table stays empty.
    """
    return drop_near_duplicates(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are replaced by their kind.

    Null stays null and empty stays empty; the longest of overlapping spans counts, of equal ones the first kind; texts are
    searched whole; repeated rows come out equal. An empty table stays empty.
    """
    return _documents(docs, redact)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are laid out in the order of the mix; all of them stay, with null, empty and long texts, repeated rows too.

    A null source counts as the source ''; equal rows may trade places. An empty table stays empty.
    """
    return _documents(docs, lambda df: in_mix_order(mix(df)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their count and the bytes they decode to, as digests beside the ids' source row,
    with the row's place in the mix (slot, row_in_block) and in its order.

    Files don't keep an order when they are read again, so the place is worked out anew from the ids and sources
    of all rows: on the short rows made here, as mix_sources did on the documents. Null and empty texts have no tokens;
    repeated rows get equal tokens and places of their own; texts are encoded whole. Other columns go. An empty table stays empty.
    """
    made = encode(docs.select("doc_id", "source", "text"), decoding=True)
    made = made.select("doc_id", "source", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    mixed = in_mix_order(mix(stored(made, "pipeline-digests")))
    return mixed.select(*made.columns, "slot", "row_in_block")


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("private_data", private_data), ("mix_sources", mix_sources), ("tokens", tokens)]

#: Near-duplicate groups by signatures, rank-queue merges and learnt patterns aren't SQL; tests
#: hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"pipeline-{name}")
    return docs
