"""Readers and writers. Everything goes through Spark's readers, so any store works that Spark reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null

_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without it gets a new one, on a cluster it must be set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: what several steps read is computed once and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """``source`` (file name), ``path``, ``text`` of all Markdown files below ``folder``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("wholetext", "true").text(folder)
    path = F.col("_metadata.file_path")
    return files.select(F.element_at(F.split(path, "/"), -1).alias("source"), path.alias("path"), F.col("value").alias("text"))


def paragraphs(texts: DataFrame, text: str = "text") -> DataFrame:
    """A row for each paragraph between blank lines, with ``position``; blank ones drop."""
    parts = F.posexplode(F.split(F.col(text), r"\n\s*\n+"))
    return texts.select("*", parts.alias("position", "paragraph")).where(F.trim("paragraph") != "").drop(text)


def json_items(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Items of JSON lines, of a list, of one item, or of a map from ids to items (the id fills an empty ``id``)."""
    item = T._parse_datatype_string(schema)
    if lines:
        return spark.read.schema(item).json(path)
    whole = spark.read.option("wholetext", "true").text(path).select(F.trim("value").alias("raw"))
    listed = whole.where(F.col("raw").startswith("[")).select(F.explode(F.from_json("raw", T.ArrayType(item))).alias("x"))
    mapped = whole.where(F.col("raw").startswith("{"))
    by_id = F.from_json("raw", T.MapType(T.StringType(), T.StringType()))
    # an item's own fields aren't objects, those of a map are
    is_map = F.forall(F.map_values(by_id), lambda v: v.startswith("{")) & (F.size(by_id) > 0)
    one = mapped.where(~F.coalesce(is_map, F.lit(False))).select(F.from_json("raw", item).alias("x"))
    many = mapped.where(is_map).select(F.explode(by_id).alias("key", "v")).select("key", F.from_json("v", item).alias("x"))
    if "id" in item.names:
        many = many.select(F.col("x").withField("id", F.coalesce(F.col("x.id"), F.col("key"))).alias("x"))
    else:
        many = many.select("x")
    return listed.unionByName(one).unionByName(many).select("x.*")


def last_of_each(items: DataFrame, key: str, order: str) -> DataFrame:
    """Of items with one key the last one in ``order``."""
    return items.groupBy(key).agg(F.max_by(F.struct(*items.columns), order).alias("x")).select("x.*")


def corpus(rows: DataFrame) -> DataFrame:
    """A frozen corpus: rows with a text, ``doc_id`` their evidence id or else their row id."""
    return rows.where(blank_to_null(F.col("text")).isNotNull()).withColumn("doc_id", F.coalesce(blank_to_null(F.col("evidence_id")), F.col("row_id").cast("string")))


def write_new(df: DataFrame, path: str, overwrite: bool = False, by: list[str] | None = None) -> None:
    """Parquet; a folder that has something in it is refused unless ``overwrite``."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    """One JSON line for each row, added to a run log."""
    df.write.mode("append").json(path)


def write_alignment(aligned: DataFrame, folder: str) -> None:
    """All alignments, and the ones that need review on their own."""
    aligned.write.mode("errorifexists").partitionBy("status").parquet(f"{folder}/alignments")
    aligned.where("status = 'needs_review'").write.mode("errorifexists").json(f"{folder}/review")


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Triples; of repeated (head, relation, tail) the first position stays."""
    rows = spark.read.parquet(path)
    return rows.groupBy("head", "relation", "tail").agg(F.min_by(F.struct(*rows.columns), "position").alias("x")).select("x.*")
