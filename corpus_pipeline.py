"""Documents to training tokens: rules, near copies, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provlake.llm import bpe, minhash, mixing, quality_rules, suffix_dedup
from provlake.llm._shared import forget, mark, saved, table


def _apart(docs: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What make leaves of docs, where other columns than those of documents have names that no operator uses."""
    names = {c: f"own_{k}_of_docs" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang", "source", "n_chars")}
    apart = docs.withColumnsRenamed(names)
    return make(apart).select(*apart.columns).withColumnsRenamed({v: k for k, v in names.items()})


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go; rows are judged one by one, so repeated rows share their fate; long
    texts are judged whole. All columns stay, whatever their names. Empty in, empty out.
    """
    return _apart(docs, lambda d: quality_rules.quality_rules(d).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one of the smallest id.

    Of rows of one id the first by text stays; rows with a null id, and texts that are null or hold no word, are in no
    class with others and stay. Long texts are compared whole. All columns stay. Empty in, empty out.
    """
    return minhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that documents of smaller ids have; n_chars follows the text.

    Every row stays, with all columns: a null text stays null (n_chars too), an emptied one is empty. Rows of one id take
    nothing from each other; a null id comes after all others. Empty in, empty out.
    """
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens have the target shares of source, language and topic.

    Null is a source or language like others; null and empty texts have no tokens and stay. Rows of one id and cell share
    their fate; rows of a null id are told apart by their texts. All columns stay. Empty in, empty out.
    """
    return _apart(docs, lambda d: mixing.mixed(d).where("kept"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document.

    Every row is encoded for itself, null as the empty text, long texts whole. Other columns are left out. Empty in,
    empty out.
    """
    import public_tokenizers

    made = bpe.bpe_encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return made.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality_rules", rules), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's own tables are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        since = mark()
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
        forget(spark, since, but=1)
    return docs


#: Iterative stages aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None
