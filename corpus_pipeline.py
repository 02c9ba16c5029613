"""Corpus pipeline: quality, line dedup, near duplicates, mixing and packing of ``documents``, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of
``documents``.  Results of the stages are written as Parquet to the shared folder and read again.

Defined results: a null or empty text is judged as one empty line, has no line that goes, is no near duplicate of any
other, is never taken by the mix where its source's target is below its size, and is packed as an end token.  Of rows with
the same doc_id, the near-duplicate stage keeps the one with the smallest text; rows without a doc_id pass it and are mixed
and packed like others, but their lines stay.  Repeated rows are mixed as rows of their own.  An empty table gives an empty
result.  Further columns, whatever their names, are carried up to the mix.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanledger.llm import line_dedup, mixing, ngram_join, packing, quality
from scanledger.llm.common import may_hold, settle, table, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_position(stage):
    """The stage with further columns renamed while it runs, so that their names meet none of its own."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [c if c in COLUMNS else f"_x{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*names)

    return run_stage


@by_position
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@by_position
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand (nearly) alike in an earlier place; those left without any text go."""
    left = line_dedup.without_lines(docs, line_dedup.dedup_lines(docs, least=line_dedup.LEAST))
    left = left.where("_gone = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("_gone") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left


@by_position
def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word shingles, the one with the smallest id; of rows with one id, that with the smallest text."""
    found = settle(ngram_join.jaccard_components(docs))
    losers = found.where("doc_id <> component_id").select("doc_id").distinct()
    twice = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    touched = settle(losers.union(twice).distinct())
    same = without(docs, "doc_id", touched)
    judged = may_hold(docs, "doc_id", touched).join(losers, "doc_id", "left_anti").select(*docs.columns)
    order = F.struct(F.coalesce("text", F.lit("")), F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    first = judged.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return same.unionByName(first)


@by_position
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = settle(mixing.mix_documents(docs))
    twice = settle(mixed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    taken = mixed.where("copies > 0").select("doc_id", F.col("source").alias("_source"), F.col("size").alias("_size_m"), "copy_no", "copies")
    # Ids of one row are joined as they are; a bitmap parts them from most others, and the copies of those are numbered.
    alone = without(docs, "doc_id", twice).where("doc_id is not null").join(taken.select("doc_id", "copies").hint("merge"), "doc_id").select(*docs.columns, "copies")
    rest = may_hold(docs, "doc_id", twice).unionByName(docs.where("doc_id is null"))
    among = Window.partitionBy("doc_id", "source", "_size").orderBy(F.xxhash64("text"))
    rest = rest.withColumn("_size", mixing.word_count(F.col("text"))).withColumn("_no", F.row_number().over(among) - 1)
    rest = rest.join(taken.withColumnRenamed("doc_id", "_id"), F.expr("doc_id <=> _id and source <=> _source and _size = _size_m and _no = copy_no"))
    every = alone.unionByName(rest.select(*docs.columns, "copies"))
    return every.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("mixing to target weights", mix_to_targets),
    ("packing", pack),
]

#: No SQL: the field, the sample and the tokenizer are beyond it; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
