"""Document fingerprints: threshold-scaled sketches of word shingles, in built-in functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range, so sketches of texts of any lengths
can be merged (union) and compared: the share of one sketch found in another estimates containment, intersection over
union likeness.  Where no hash of a text with words falls below the threshold, its smallest hash is kept, so that only
texts without words have an empty sketch; ``merged`` drops it again where the other sketch has any below the threshold.

Defined results: a null text counts as empty; texts with fewer words than a shingle have their whole sequence as the one
shingle; two empty sketches have likeness and containment 1, an empty and another one 0; rows with the same doc_id count
once when the next document is sought (the smaller text stands for it), and each of them is a row of the result; the only
document of a table is its own next; rows without a doc_id have no place in the order and are left out; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SPACE, blocks_for, pick, settle

#: One hash in ``SCALE`` is kept.
SCALE = 8
SHINGLE = 5
RANGE_ROWS = 50_000


def word_array_hashes(text: Column) -> Column:
    """Hashes of a text's words, in order."""
    return F.transform(F.filter(F.split(text, WORD_SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def shingle_hashes(words: str, n: int = SHINGLE) -> Column:
    """Hashes of the runs of n words of the column ``words`` of word hashes (a column of its own, so that it is computed once)."""
    w = F.col(words)
    many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
    return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def kept(shingles: str, scale: int = SCALE) -> Column:
    """The distinct hashes below the threshold, ascending; the smallest one where there is none below it."""
    below = F.lit(-(1 << 63) + (1 << 64) // scale)
    s = F.col(shingles)
    low = F.array_sort(F.array_distinct(F.filter(s, lambda h: h < below)))
    return F.when(F.size(low) > 0, low).when(F.size(s) > 0, F.array(F.array_min(s))).otherwise(low)


def merged(a: str, b: str, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone."""
    below = F.lit(-(1 << 63) + (1 << 64) // scale)
    both = F.array_sort(F.array_union(a, b))
    return F.when(F.exists(both, lambda h: h < below), F.filter(both, lambda h: h < below)).otherwise(F.slice(both, 1, 1))


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the sketch of the column ``text`` as column ``name``."""
    out = [F.col(c) for c in df.columns]
    df = df.select(*out, word_array_hashes(F.col(text)).alias("_words"))
    df = df.select(*out, shingle_hashes("_words").alias("_shingles"))
    return df.select(*out, kept("_shingles").alias(name))


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.col(a)) + F.size(F.col(b)) - common
    return F.when(union > 0, common / union).otherwise(F.lit(1.0))


def containment(a: str, b: str) -> Column:
    """Estimated share of the first sketch's text that is in the second's."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).when(F.size(b) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def as_string(sketch: str, scale: int = SCALE) -> Column:
    return F.concat(F.lit(f"{scale}:"), F.array_join(F.transform(sketch, lambda h: F.hex(h)), ","))


def next_ids(rows: DataFrame) -> DataFrame:
    """doc_id, next_id, need: every distinct id, the one after it (the first after the last), and half its characters.

    Ids are ranged into blocks; within a block the next row follows, and the last of a block gets the first of the next.
    """
    keys = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.length("text")).alias("n"))
    keys = settle(keys)
    ranged = settle(keys.repartitionByRange(blocks_for(keys.count(), RANGE_ROWS), "doc_id").withColumn("block", F.spark_partition_id()))
    by_block = Window.orderBy("block")
    heads = ranged.groupBy("block").agg(F.min("doc_id").alias("head"))
    heads = heads.select("block", F.coalesce(F.lead("head").over(by_block), F.min("head").over(Window.partitionBy(F.lit(1)))).alias("after"))
    inside = ranged.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("block").orderBy("doc_id")))
    return settle(inside.join(F.broadcast(heads), "block").select("doc_id", F.coalesce("next_id", "after").alias("next_id"), F.floor(F.col("n") / 2).cast("int").alias("need")))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sketches of each text, of its edited text and of the next document's text.

    doc_id, n_chars, edited (the edited text), sketch, edited_sketch, next_sketch.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    follow = next_ids(rows)
    # Each document sends its beginning and its sketch to the one before it.
    sent = rows.join(follow.select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("to_id"), "need"), "doc_id")
    sent = with_sketch(sent, "text", "next_sketch").select("to_id", F.expr("substring(text, 1, need)").alias("piece"), "next_sketch")
    sent = sent.groupBy("to_id").agg(F.min(F.struct("piece", "next_sketch")).alias("sent")).select(F.col("to_id").alias("doc_id"), "sent.*")
    both = rows.join(sent, "doc_id")
    n = F.length("text")
    both = both.withColumn("n_chars", n.cast("long")).withColumn("edited", F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 2) as int)), substring(piece, 1, cast(floor(length(text) / 2) as int)))"))
    both = with_sketch(both.select("doc_id", "n_chars", "text", "edited", "next_sketch"), "text", "sketch").drop("text")
    return with_sketch(both, "edited", "edited_sketch")
