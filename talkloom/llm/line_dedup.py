"""Line dedup: lines that many documents hold are dropped from all of them but one.

A line's key is the line without white space at its ends, with A-Z lower-cased; it travels as two
64-bit hashes of different seeds. Rows (hashes, document, position) are dealt by ranges of the hash and sorted by
document and position within it. Streaming over them, the first document of a key keeps its lines; the lines of all
others are dropped if there are at least that many documents. What comes back isn't text but each document's keep
bitmap, as runs: the first line of each stretch that stays, and its length. Documents that lose nothing have none.

A key that very many rows hold would fall into one range. Rows are tallied by the first 16 bits of their
hash, which bounds the count of each key; keys of more than 2/65536 of all rows, of which there can be
no more than 32,768, are counted exactly, judged by aggregates that combine before the shuffle, and sent to
all executors. The others go by ranges, of which none then holds much more than its share.

All is built of DataFrame functions. Defined results: a null or empty text is one empty line; a null id counts as one
document, before all others; rows that repeat an id count as one document, each with a bitmap of its own (rows are told
apart by a hash of their text, so equal rows are treated alike); long texts are read whole; an empty table gives no
rows; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkloom.llm.common import ascii_lower, written

BLANK = " \t\n\x0b\f\r"
LEAST_CHARS, LEAST_DOCUMENTS = 20, 3
#: Keys that hold more than 2 of BUCKETS parts of all rows, and more than LEAST_HOT rows, don't go by ranges.
BUCKETS, LEAST_HOT = 1 << 16, 1000
KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(ascii_lower(bare))


def row_hash(text: Column) -> Column:
    return F.xxhash64(text)


def keys(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """h1, h2, doc_id, row_hash, n_lines, pos of every line whose key has that many characters."""
    each = docs.select("doc_id", row_hash(F.col("text")).alias("row_hash"), lines_of(F.col("text")).alias("lines"))
    each = each.select("doc_id", "row_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
    each = each.where(F.char_length("line") >= least_chars).withColumn("key", key_of(F.col("line"))).where(F.char_length("key") >= least_chars)
    return each.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "row_hash", "n_lines", "pos")


def crowded(rows: DataFrame, buckets: int = BUCKETS, least: int = LEAST_HOT) -> DataFrame:
    """The hashes that more than max(2 / buckets of all rows, least) rows have: fewer than buckets / 2."""
    limit = max(2 * rows.count() // buckets, least)
    bucket = F.shiftrightunsigned("h1", 64 - (buckets.bit_length() - 1))
    full = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).where(F.col("n") > limit).select("bucket")
    inside = rows.select(*KEY, bucket.alias("bucket")).join(F.broadcast(full), "bucket", "left_semi")
    return inside.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(*KEY)


def dropped(rows: DataFrame, least_documents: int = LEAST_DOCUMENTS, buckets: int = BUCKETS, least_hot: int = LEAST_HOT) -> DataFrame:
    """Those of the rows of keys() whose line goes: the key is in enough documents, and this isn't the one with the largest id."""
    hot = written(crowded(rows, buckets, least_hot), "crowded-lines")
    some = not hot.isEmpty()
    cold = rows.join(F.broadcast(hot), KEY, "left_anti") if some else rows
    stream = cold.repartitionByRange(*KEY).sortWithinPartitions(*KEY, F.desc_nulls_last("doc_id"), "row_hash", "pos")
    nth = F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("doc_id")))
    out = stream.withColumn("nth", nth).withColumn("n_docs", F.max("nth").over(Window.partitionBy(*KEY)))
    out = out.where((F.col("nth") > 1) & (F.col("n_docs") >= least_documents)).select(*rows.columns)
    if not some:
        return out
    of_hot = rows.join(F.broadcast(hot), KEY, "left_semi")
    told = of_hot.groupBy(*KEY).agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"), F.max("doc_id").alias("last")).where(F.col("n_docs") >= least_documents)
    gone = rows.join(F.broadcast(told), KEY).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return out.unionByName(gone.select(*rows.columns))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_documents: int = LEAST_DOCUMENTS, buckets: int = BUCKETS, least_hot: int = LEAST_HOT) -> DataFrame:
    """doc_id, row_hash and keep (array of first and n: the stretches of lines that stay) of the documents that lose lines."""
    rows = written(keys(docs, least_chars), "line-keys")
    gone = dropped(rows, least_documents, buckets, least_hot)
    of = gone.groupBy("doc_id", "row_hash").agg(F.max("n_lines").alias("n_lines"), F.sort_array(F.collect_set("pos")).alias("at"))
    ends = of.select("doc_id", "row_hash", F.concat(F.array(F.lit(-1)), "at").alias("a"), F.concat("at", F.array("n_lines")).alias("b"))
    stretch = F.zip_with("a", "b", lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("n")))
    return ends.select("doc_id", "row_hash", F.filter(stretch, lambda s: s["n"] > 0).alias("keep"))


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: the lines that stay, joined again."""
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_hash(F.col("text")).alias("row_hash")).alias("d")
    told = told.join(bitmaps.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.row_hash") == F.col("b.row_hash")), "left")
    cut = told.select("d.doc_id", "text", "keep", lines_of(F.col("text")).alias("lines"))
    kept = F.array_join(F.flatten(F.transform("keep", lambda s: F.slice("lines", s["first"] + 1, s["n"]))), "\n")
    stays = F.aggregate("keep", F.lit(0), lambda n, s: n + s["n"])
    n_lines = F.size("lines")
    return cut.select(
        "doc_id",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_lines - stays, F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("text")).otherwise(kept).alias("kept"),
    )
