"""A training-data pipeline over documents: five stages, each one operator of talkloom.llm.

Every stage reads what the one before it has written, works on all of it, and its decisions take
effect. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import bpe, decontaminate, langid, near_copies, suffix_dedup
from talkloom.llm.common import passing, save, scratch_path, table, written

#: A document is rejected when no language has this probability.
LEAST_SCORE = 0.5
#: Rows' names (16 bytes each) that are sent to all executors at once; more are joined by shuffling.
BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, find: Callable[[], DataFrame], name: str) -> DataFrame:
    """docs without the rows that find's result names by doc_id, null or not, and mark, the hash of their text: an id may be missing or repeated.

    What find has written is deleted as soon as the names are.
    """
    path = scratch_path(docs.sparkSession, name)
    with passing(docs.sparkSession):
        gone = find().select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).distinct()
        save(gone, path)
    gone = docs.sparkSession.read.schema(gone.schema).parquet(path)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_mark")), "left_anti").select(*docs.columns)


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The used columns, and all others in one struct, so that no name clashes with a result's."""
    return docs.select(*used, F.struct(F.lit(0).alias("_"), *[c for c in docs.columns if c not in used]).alias("_others"))


def _unpacked(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    return df.select(*[F.col(c) if c in used else F.col(f"_others.`{c}`").alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that no language fits; learns from the labelled rows.

    Where no row has a label there is no language to fit: all documents with a letter stay. Null texts go;
    an empty table stays empty.
    """
    model = langid.train(docs, F.lit(True))
    if not model.languages:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    told = langid.predict(_packed(docs, "text"), model)
    kept = told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return _unpacked(kept, docs.columns, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of texts whose 5-word shingles are alike by 0.8 or more.

    SimHash's Golay keys find near-equal texts, and an exact join finds the pairs beyond three bits.
    Rows are told apart by id and text, so that those that repeat an id are judged alone and only equal rows stay or go together; rows
    without an id stay only where no row of their group has one. Null and empty texts are alike. An empty table stays empty; texts of any length are read whole;
    other columns are carried along, whatever their names.
    """
    least = F.col("doc_id").eqNullSafe(F.col("component_id")) & ((F.col("mark") == F.col("component_mark")))
    return _without(docs, lambda: near_copies.near_duplicates(docs.select("doc_id", "text"), marks=True).where(~least), "near-duplicates")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long strings that documents with smaller ids have; what is left of a cut character goes too.

    A document of which nothing but white space is left goes, as do null texts. Documents without an id count as
    the last ones. An empty table stays empty.
    """
    used = ("doc_id", "text", "n_chars")
    cut = suffix_dedup.dedup(_packed(docs, *used), keep=["_others"], decode=True)
    cut = cut.where(F.col("kept").rlike(r"\S")).select("doc_id", F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"), "_others")
    return _unpacked(cut, docs.columns, *used)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, each by its id and text: a clean row that shares its id, or has none, stays.

    With an empty benchmark all stay, null and empty texts too; an empty table stays empty; texts of any length are read whole; other columns are
    carried along, whatever their names.
    """
    named = docs.select(F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("row"), "text")
    return _without(docs, lambda: decontaminate.contaminated(named, table(spark, sf_dir, "benchmark"), id_col="row").select("row.*"), "contaminated")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of the ids and of the decoded bytes.

    A null text counts as empty, repeated rows are coded alike, texts of any length whole; lang and source are carried along. An empty table gives no rows.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Four of the stages are not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
