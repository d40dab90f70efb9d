"""The record stores: JSON-lines records and trust logs, and profiles by key.

A store's order is that of its appends and of the lines in them, which Spark doesn't keep: reading
gives each line its place (seq), and everything that means "last" or "newest" goes by seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("keywords", T.ArrayType(T.StringType())),
        T.StructField("create_time", T.StringType()),
        T.StructField("update_time", T.StringType()),
        T.StructField("user_prediction", T.StringType()),
        T.StructField("user_risk", T.StringType()),
        T.StructField("agent_empathy", T.StringType()),
        T.StructField("agent_action", T.StringType()),
    ]
)
TRUST = T.StructType([T.StructField("user_input", T.StringType()), T.StructField("change", T.IntegerType()), T.StructField("trust_score", T.IntegerType())])
LAYERS = ("Meta_Layer", "Cognitive_Layer", "Behavior_Layer", "Concrete_Layer")


def _fs(spark: SparkSession, path: str):
    """The path as Hadoop's, and the file system it is in."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the entries of a folder that are named prefix and a number, in order."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())


def _claimed(spark: SparkSession, path: str, prefix: str) -> int:
    """The next number of such entries of a folder. It is claimed by creating a file, which only one of two writers can."""
    n = max(_numbers(spark, path, f"_{prefix}") + _numbers(spark, path, prefix), default=0) + 1
    while True:
        p, fs = _fs(spark, f"{path.rstrip('/')}/_{prefix}{n}")
        if fs.createNewFile(p):
            return n
        n += 1


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq and line of the non-blank lines; seq is a struct that orders them. A missing store has none.

    A store is a file, or a folder of files. Lines stand in the order of their appends, of the files
    of an append (or of names, for files that no append has written), and of their places in a file.
    Large files are split over tasks.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "seq struct<batch:long,part:long,file:string,block:long,row:long>, line string")
    file = F.col("_metadata.file_path")
    number = lambda pattern: F.regexp_extract(file, pattern, 1).try_cast("long")
    seq = F.struct(
        F.coalesce(number(r"/batch-(\d+)/"), F.lit(0)).alias("batch"), F.coalesce(number(r"/part-(\d+)"), F.lit(0)).alias("part"), file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
    )
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(seq.alias("seq"), F.col("value").alias("line"))
    return lines.where(F.btrim("line") != "")


def good(lines: DataFrame) -> DataFrame:
    """Adds good: whether the line is a JSON object."""
    kind = F.schema_of_variant(F.try_parse_json("line"))
    return lines.withColumn("good", F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))


def parsed_records(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """seq and the fields of the good lines; missing or null ones are empty strings (or empty arrays) where the schema has strings (arrays)."""
    lines = lines.where("good").withColumn("r", F.from_json("line", schema))
    cols = []
    for f in schema.fields:
        c = F.col(f"r.{f.name}")
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit(""))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.coalesce(c, F.array().cast(f.dataType))
        cols.append(c.alias(f.name))
    return lines.select("seq", *cols)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """The records with their seq. Lines that aren't JSON objects are skipped; fields that are
    missing or null are empty strings (or empty arrays) where the schema has strings (arrays)."""
    return parsed_records(good(read_lines(spark, path)), schema)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq and line of the lines that read_jsonl skips."""
    return good(read_lines(spark, path)).where(~F.col("good")).select("seq", "line")


def append_jsonl(records: DataFrame, path: str, columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """Appends records as JSON lines with all fields present, null or not.

    order: columns that tell the records' order within this append; without them they stand as
    the DataFrame's partitions have them. Each append has a folder of its own, numbered; a
    number is claimed by creating a file, so that two writers can't take the same one.
    """
    spark = records.sparkSession
    cols = columns or records.columns
    line = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    n = _claimed(spark, path, "batch-")
    lines = (records.orderBy(*order) if order else records).select(line.alias("value"))
    lines.write.text(f"{path.rstrip('/')}/batch-{n}")


def clear(spark: SparkSession, path: str) -> bool:
    """Deletes a store; a missing one is already clear."""
    if not _exists(spark, path):
        return True
    p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def latest(records: DataFrame, *keys: str, order: str = "seq") -> DataFrame:
    """The last record by order, of each key if keys are given."""
    others = [c for c in records.columns if c not in keys]
    last = F.max_by(F.struct(*others), order).alias("r")
    grouped = records.groupBy(*keys).agg(last) if keys else records.agg(last)
    return grouped.where("r is not null").select(*keys, "r.*")


def newest_first(records: DataFrame, order: str = "seq") -> DataFrame:
    return records.orderBy(F.desc(order))


def last_trust(spark: SparkSession, path: str) -> int:
    """The trust score of the log's last line; 0 for no log, no line, or a last line that isn't a record."""
    lines = read_lines(spark, path)
    row = lines.agg(F.max_by("line", "seq").alias("line")).select(F.from_json("line", TRUST).alias("r")).first()
    return row["r"]["trust_score"] if row and row["r"] and row["r"]["trust_score"] is not None else 0


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """One row with the document as a variant, or none where the file is missing or not JSON."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "document string").select(F.try_parse_json("document").alias("document"))
    return spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("document")).where("document is not null")


def _version(spark: SparkSession, path: str) -> int:
    """The last version that was written in full, or 0."""
    return max((n for n in _numbers(spark, path, "version-") if _exists(spark, f"{path.rstrip('/')}/version-{n}/_SUCCESS")), default=0)


def load_profile(spark: SparkSession, persisted: str, default: DataFrame, key: str = "id", save: bool = True) -> DataFrame:
    """The persisted profile of each key, else the default one; the keys are those of both.

    Profiles that come from the default are persisted at once, unless save is false.
    """
    n = _version(spark, persisted)
    if not n:
        found = default
    else:
        own = spark.read.parquet(f"{persisted.rstrip('/')}/version-{n}")
        new = default.join(own.select(key), key, "left_anti")
        if new.isEmpty():
            return own
        found = own.unionByName(new, allowMissingColumns=True)
    if not save:
        return found
    save_profile(found, persisted)
    return spark.read.schema(found.schema).parquet(f"{persisted.rstrip('/')}/version-{_version(spark, persisted)}")


def save_profile(profiles: DataFrame, path: str) -> None:
    """Overwrites a profile table. The new version stands beside the old one until it is complete, so
    profiles may be computed from the very table; the version before the old one is deleted. Of two writers each takes
    a number of its own, and the higher one's version counts."""
    spark, at = profiles.sparkSession, path.rstrip("/")
    old = _version(spark, at)
    new = _claimed(spark, at, "version-")
    profiles.write.parquet(f"{at}/version-{new}")
    for n in _numbers(spark, at, "version-"):
        if n < old:
            p, fs = _fs(spark, f"{at}/version-{n}")
            fs.delete(p, True)


def layer_merge(old: Column, new: Column) -> list[Column]:
    """Each layer as JSON text: the new document's where it has the key (null included), else the old one's.

    Documents are JSON text; keys other than the four layers are dropped.
    """
    has = F.coalesce(F.json_object_keys(new), F.array().cast("array<string>"))
    return [F.when(F.array_contains(has, k), F.get_json_object(new, f"$.{k}")).otherwise(F.get_json_object(old, f"$.{k}")).alias(k) for k in LAYERS]
