"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the blank and the code points 9 to 13.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns ``wanted`` (alias=name) and no others.

    Columns are found by position, so further columns whose names differ only in case, or occur twice, do no harm.
    """
    names = df.columns
    lower = [n.lower() for n in names]
    plain = df.toDF(*[f"_c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_c{names.index(n) if n in names else lower.index(n.lower())}").alias(a) for a, n in wanted.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or where it is unset a place in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_settled"


def _files_at(spark: SparkSession, path: str):
    """(file system, path) of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, place = _files_at(spark, path)
    files.deleteOnExit(place)
    back = spark.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove what ``settle`` wrote, once nothing reads it any more."""
    files, place = _files_at(df.sparkSession, df._settled_at)
    files.delete(place, True)


def blocks_for(n: int, each: int) -> int:
    """Blocks of about ``each`` rows that ``n`` rows make, at least one."""
    return max(1, -(-int(n) // each))


#: Most words of the bitmap of ``may_hold``: 2^18 longs, 2^24 bits (2 MB), at any size of the data; unused words take no room.
BITMAP_WORDS = 1 << 18


def _bit_of(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    at = F.pmod(F.xxhash64(F.col(key)), F.lit(BITMAP_WORDS * 64))
    word, bit = (at / 64).cast("int"), (at % 64).cast("int")
    bits = ids.where(F.col(key).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    word = F.when(F.col(key).isNotNull(), word)
    return df.withColumn("_word", word).withColumn("_at", bit).join(F.broadcast(bits), "_word", "left")


def may_hold(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``key`` is not in ``ids`` (a column of the same name); none that is there is lost.

    The ids are folded into a bitmap of bounded size, which is small enough to be broadcast however many ids there are; as
    it fills up it lets more rows through.  It spares a shuffle of large rows before the exact join.
    """
    return _bit_of(df, key, ids).where("getbit(_bits, _at) = 1").select(*df.columns)


def without(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows that ``may_hold`` drops, rows with a null key among them."""
    return _bit_of(df, key, ids).where("coalesce(getbit(_bits, _at), 0) = 0").select(*df.columns)


def sliced(batches, rows: int = 1024, column: int | None = None, size: int = 0):
    """Record batches cut to at most ``rows`` rows, so that what is built per batch stays small.

    With ``column``, cut by the bytes of that column instead: about ``size`` of them, one row at least.
    """
    for batch in batches:
        if column is None:
            cuts = range(rows, batch.num_rows + rows, rows)
        else:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts, last = [], 0
            while last < batch.num_rows:
                before = int(ends[last - 1]) if last else 0
                last = max(int(np.searchsorted(ends, before + size, side="right")), last + 1)
                cuts.append(last)
        at = 0
        for cut in cuts:
            if at < batch.num_rows:
                yield batch.slice(at, cut - at)
            at = cut


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in ``edges`` (a, b): columns id, label.

    Every round takes the least label among the neighbours and then the label of the label, so that paths halve; each
    round is settled, and only the number of changed labels comes to the driver.
    """
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a"))
    before = labels = settle(both.groupBy("id").agg(F.least("id", F.min("other")).alias("label")))
    both = settle(both)
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        step = settle(step.join(jump, "label", "left").select("id", F.coalesce("further", "label").alias("label"), "was"))
        done = not step.where("label <> was").limit(1).count()
        discard(before)
        before, labels = step, step.select("id", "label")
        if done:
            discard(both)
            return labels
