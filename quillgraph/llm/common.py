"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of a word: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z in UTF-8 bytes. ``bytes.split()`` then yields exactly the words.
LOWER_AZ = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, or the context's checkpoint folder; a local session without either gets a new one.

    On a cluster a folder of one machine would be a different one on each executor, so there the setting is needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or _local.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return base.rstrip("/")


_local: dict[str, str] = {}


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of at most ``rows`` rows while a table is written, so that long texts stay small in memory; then as it was."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stash(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, keeps columns prunable and gives the optimizer real sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with small_batches(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """Hint a broadcast only if ``df`` has at most ``most`` rows; otherwise leave the join to the optimizer.

    ``df`` should be stashed, since its rows are counted here (up to ``most`` + 1).
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def slices(batches: Iterable, most_rows: int = 1000, most_bytes: int = 8_000_000):
    """The rows of Arrow batches in parts of at most ``most_rows``, fewer where they are long, so Python objects of few rows live at once."""
    for batch in batches:
        rows = max(1, min(most_rows, most_bytes * max(batch.num_rows, 1) // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts(batches: Iterable, text: str = "text"):
    """Parts of Arrow batches with their texts as bytes (null: empty)."""
    import pyarrow as pa

    for batch in slices(batches):
        column = batch.column(batch.schema.get_field_index(text))
        yield batch, [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def heaviest(counts: DataFrame, key: str, n: str = "n", most: int = 10_000) -> DataFrame:
    """The ``most`` rows of largest ``n``, written out. Any other key has less than one in ``most`` of all that ``n`` counts."""
    return stash(counts.orderBy(F.desc(n), key).limit(most))


def join_spread(rows: DataFrame, values: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``values`` (one row for each ``key``), an inner join.

    Rows of the keys in ``heavy`` (rows of ``values``, bounded by ``heaviest``) meet a broadcast where they lie; only the
    others are shuffled, and none of their keys holds more than a small share of them.
    """
    heavy = F.broadcast(heavy)
    rest = rows.join(heavy.select(key), key, "left_anti").join(values.join(heavy.select(key), key, "left_anti"), key)
    return rows.join(heavy, key).unionByName(rest)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column in ``taken`` has it."""
    taken = [c.lower() for c in taken]
    while name.lower() in taken:
        name += "_"
    return name
