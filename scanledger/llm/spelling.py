"""Grouping of spelling variants by pivotal grams.

Words one edit apart share a bigram that the edit leaves alone.  All bigrams are ordered, rare ones first.  A word's prefix is
its first three bigrams in that order (with all places of the third); among them two that don't overlap are its pivots,
chosen by dynamic programming so that the words holding them are fewest.  One edit touches one of two disjoint bigrams at
most, so the other stands in the near word, at a place that the two lengths fix but for one; and if the word's prefix
ends no later in the order than the near word's, it stands in that one's prefix.  Pivots therefore probe an index of
prefixes by bigram, place and length.  What is left is thinned by bitmaps of letters and of bigrams, which one edit
changes in few bits, and verified by the edit distance.

Index entries carry a word's number and its bitmaps, never the word; keys that hold many entries are dealt out in parts of
``PART`` entries, to each of which the probes of that key go.

Defined results: a null text has no words; a row without an id counts as one whose id is written as nothing; rows that share
an id count as rows of their own; a word without near words has no form and is its own root; ties between forms go to the
smallest in code-point order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, settle, sliced

LETTERS = r"([A-Za-zÀ-ÿ]+)"
#: Fewest code points and occurrences of a word.
SHORTEST, RAREST = 6, 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: One run in so many loses a letter (the contract's planted errors).
ERRORS = 199
#: Entries of a key of the index that one part holds.
PART = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS, PIVOTS = 3, 2


def planted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", errors: int = ERRORS) -> DataFrame:
    """word of every run of letters: lower-cased (A-Z alone), one in ``errors`` without one of its letters."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    runs = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(LETTERS), 1)).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    cut = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), cut), F.substring(F.col("run"), cut + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % errors == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


def choose_pivots(places: list[int], weights: list[int], k: int = PIVOTS, width: int = 2) -> list[int]:
    """The k of ``places`` (ascending) that don't overlap and whose weights sum to the least; the leftmost of equal choices.

    Programmed over the places: best[j] is the cheapest choice of j among those so far that end before the next.
    """
    inf = (float("inf"), ())
    best = [[(0, ())] + [inf] * k]
    for i, at in enumerate(places):
        before = i
        while before and places[before - 1] + width > at:
            before -= 1
        row = [(0, ())]
        for j in range(1, k + 1):
            cost, chosen = best[before][j - 1]
            row.append(min(best[-1][j], (cost + weights[i], (*chosen, at))))
        best.append(row)
    return list(best[-1][k][1])


def _bit(code: int) -> int:
    return (code * 0x9E3779B97F4A7C15 >> 32) & 63


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _grams(ranks: dict[str, tuple[int, int]]):
    """Entries of words: (id, len, letters, grams, last, and for the index and the probes their bigrams and places)."""

    def of_word(word: str) -> tuple:
        grams = [word[i : i + 2] for i in range(len(word) - 1)]
        ordered = sorted(range(len(grams)), key=lambda i: (ranks[grams[i]][0], i))
        last = ranks[grams[ordered[GRAMS - 1]]][0]
        first = sorted(ordered[:GRAMS])
        pivots = choose_pivots(first, [ranks[grams[i]][1] for i in first])
        index = [i for i in ordered if ranks[grams[i]][0] <= last]
        letters = gram_bits = 0
        for c in set(word):
            letters |= 1 << _bit(ord(c))
        for g in set(grams):
            gram_bits |= 1 << _bit(ord(g[0]) << 16 | ord(g[1]))
        return _signed(letters), _signed(gram_bits), last, [(ranks[grams[i]][0], i) for i in index], [(ranks[grams[i]][0], i) for i in pivots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=1 << 16):
            out = [of_word(w) for w in batch.column(1).to_pylist()]
            pair = pa.list_(pa.struct([("gram", pa.int32()), ("at", pa.int32())]))
            told = [[[{"gram": g, "at": a} for g, a in o[k]] for o in out] for k in (3, 4)]
            size = pa.array(np.array([len(w) for w in batch.column(1).to_pylist()], np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), size, *[pa.array([o[k] for o in out], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))], *[pa.array(t, pair) for t in told]],
                names=["id", "len", "letters", "grams", "last", "index", "pivots"],
            )

    return run


ENTRY = "id long, len int, letters long, grams long, last int, index array<struct<gram: int, at: int>>, pivots array<struct<gram: int, at: int>>"


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Of each bigram its place in the order (rare first) and the number of words that hold it.

    Words are made of 90 letters (26 and the 64 from U+00C0 on), so there are 8100 bigrams at most, however many words.
    """
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.select(F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2))))).alias("gram")).groupBy("gram").count()
    return {g: (i, n) for i, (n, g) in enumerate(sorted((r["count"], r["gram"]) for r in grams.collect()))}


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """a, b: the ids of all pairs of ``words`` (id, word; six code points or more) that differ by exactly one edit, each pair once."""
    entries = settle(words.select("id", "word").mapInArrow(_grams(gram_ranks(words)), ENTRY))
    index = entries.select("id", "letters", "grams", "last", "len", F.inline("index"))
    probes = entries.select(F.col("id").alias("p_id"), F.col("letters").alias("p_letters"), F.col("grams").alias("p_grams"), F.col("last").alias("p_last"), F.col("len").alias("p_len"), F.inline("pivots"))
    # A letter put in before the pivot moves it by one, one taken out moves it back, one behind it or replaced leaves it.
    moves = F.array(*[F.struct(F.lit(d).alias("longer"), F.lit(m).alias("moved")) for d, m in ((0, 0), (1, 0), (1, 1), (-1, 0), (-1, -1))])
    probes = probes.withColumn("move", F.explode(moves)).withColumn("len", F.col("p_len") + F.col("move.longer")).withColumn("at", F.col("at") + F.col("move.moved")).drop("move")
    key = ["gram", "at", "len"]
    sizes = settle(index.groupBy(*key).agg(F.count("*").alias("size"))).withColumn("parts", F.ceil(F.col("size") / part).cast("int"))
    dealt = index.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("size", "parts")
    sent = probes.join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("size", "parts")
    thin = F.expr("p_id <> id and p_last <= last and bit_count(p_letters ^ letters) <= 2 and bit_count(p_grams ^ grams) <= 4")
    found = sent.join(dealt, [*key, "part"]).where(thin).select(F.least("p_id", "id").alias("a"), F.greatest("p_id", "id").alias("b")).distinct()
    left, right = words.select(F.col("id").alias("a"), F.col("word").alias("wa")), words.select(F.col("id").alias("b"), F.col("word").alias("wb"))
    return found.join(left, "a").join(right, "b").where(F.levenshtein("wa", "wb", 1) == 1).select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the words in ``forms`` (word, form) that have a form: the last word when forms are followed.

    Forms grow in count at every step, so there are no cycles; each round doubles what is followed.
    """
    step = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = settle(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        done = further.where("moved").isEmpty()
        discard(step)
        step = further
        if done:
            return step.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """word, form, root, n, n_near, form_n of ``words`` (word, n)."""
    words = settle(words.withColumn("id", F.monotonically_increasing_id()))
    pairs = settle(near_pairs(words, part))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    other = words.select(F.col("id").alias("b"), F.struct((-F.col("n")).alias("less"), "word").alias("other"))
    near = both.join(other, "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("other").alias("top"))
    top_n = -F.col("top.less")
    found = words.join(near.withColumnRenamed("a", "id"), "id", "left").withColumn("strong", F.coalesce(top_n >= ratio * F.col("n"), F.lit(False)))
    found = settle(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("strong"), F.col("top.word")).alias("form"), F.when(F.col("strong"), top_n).alias("form_n")))
    led = roots(found.where("form is not null"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the texts."""
    return group_variants(vocabulary(planted_words(docs)))
