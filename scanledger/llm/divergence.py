"""Quality rules by divergence: documents that are written unlike their language are left out.

Two histograms of a document are held against its language's: of character classes and of common words.  A language's
reference is learned from all its documents that pass the base rules, each with the same weight however long it is: of
every class the median share (junk in the minority hardly moves it), and every word that takes at least one in ``COMMON`` of
the average document, so at most ``COMMON`` words.  A text of which copies make up more than one percent of the language's
rows (and that are ``LEAST_DOCS`` at least) does not speak for it; groups of near copies do.  The distance is the
square root of the Jensen-Shannon divergence to base 2, from 0 to 1.  A document fails where the classes are further away than
``CLASS_LIMIT``, or the words than ``WORD_LIMIT`` plus ``WORD_NOISE`` over the root of its number of words, since the words of
short documents scatter.  Digits are in no class: numbers, dates and keys say nothing about the language.

Guards of length: fewer than ``LEAST_WORDS`` words fail by the base rules; the classes are judged from ``LEAST_CHARS`` characters
on.  A language with fewer than ``LEAST_DOCS`` such documents has no reference: its documents are judged by their classes
alone, against the medians over all languages.

Shares are whole numbers (of 1024 and of 2^20), so that sums do not depend on their order.

Defined results: a null text counts as empty; rows without a language form a language of their own; repeated rows and rows that
share an id count each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settle, sliced
from .words import word_hashes

LEAST_WORDS = 50
LEAST_CHARS = 100
LEAST_DOCS = 20
#: A document of which more than so many percent of the words are repeated runs fails.
MOST_REPEATED = 50
CLASS_LIMIT = 0.14
WORD_LIMIT = 0.18
WORD_NOISE = 2.6
#: A word is common from one in so many words on.
COMMON = 400
#: Symbols that the base counts, and those among punctuation that count as symbols.
SYMBOLS = b"#*$%&|<>"
SIGNS = "#*%&@/_\\"
#: Classes of characters; digits are counted, but in no histogram.
WHITE, SMALL, LARGE, LETTER, POINT, SIGN, OTHER, DIGIT = range(8)
CLASSES = DIGIT
BINS = 1024
UNIT = 1 << 20
#: Words kept per task before their shares are sent on.
HELD = 1 << 20

_SPACE_BYTES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_SYMBOL_BYTES = np.isin(np.arange(256), list(SYMBOLS))
_UNKNOWN = 255
_TABLE = np.full(0x110000, _UNKNOWN, np.uint8)


def class_of(code: int) -> int:
    kind = unicodedata.category(chr(code))
    if code in (32, 9, 10, 11, 12, 13):
        return WHITE
    if kind == "Ll":
        return SMALL
    if kind in ("Lu", "Lt"):
        return LARGE
    if kind[0] in "LM":
        return LETTER
    if kind[0] == "N":
        return DIGIT
    if kind[0] == "P" and chr(code) not in SIGNS:
        return POINT
    return SIGN if kind[0] in "PS" else OTHER


def class_counts(text: str) -> np.ndarray:
    """Characters of each class, digits last."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    found = _TABLE[codes]
    new = codes[found == _UNKNOWN]
    if len(new):
        for code in np.unique(new).tolist():
            _TABLE[code] = class_of(code)
        found = _TABLE[codes]
    return np.bincount(found, minlength=CLASSES + 1)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray) -> int:
    """Words in runs of three that occur at least twice."""
    if len(words) < 4:
        return 0
    runs = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1] * np.uint64(0xBF58476D1CE4E5B9) + words[2:]
    _, which, times = np.unique(runs, return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(again)] |= again
    return int(covered.sum())


def base_counts(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = word_hashes(raw)
    kinds = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    return len(words), len(text) - int(kinds[_SPACE_BYTES].sum()), int(kinds[_SYMBOL_BYTES].sum()), repeated_lines(text), repeated_words(words)


def fails_base(n_words: int, n_repeat_words: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeat_words > MOST_REPEATED * n_words


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language: documents (kind 0), documents per class and bin (1), and words' shares (2), of those that pass the base rules."""
    held: dict[str | None, list] = {}
    size = 0

    def told():
        for lang, (docs, bins, parts) in held.items():
            keys, sums = np.concatenate([k for k, _ in parts]), np.concatenate([s for _, s in parts])
            words, at = np.unique(keys, return_inverse=True)
            shares = np.zeros(len(words), np.int64)
            np.add.at(shares, at, sums)
            used = np.flatnonzero(bins)
            kind = np.repeat(np.array([0, 1, 2], np.int32), [1, len(used), len(words)])
            key = np.concatenate([[0], used, words.view(np.int64)]).astype(np.int64)
            value = np.concatenate([[docs], bins[used], shares]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(kind), pa.array(key), pa.array(value)], names=["lang", "kind", "key", "value"])

    for batch in batches:
        for part in sliced([batch], column=1, size=1 << 22):
            for lang, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = raw or b""
                exact = word_hashes(raw)
                if fails_base(len(exact), repeated_words(exact)):
                    continue
                entry = held.setdefault(lang, [0, np.zeros(CLASSES * (BINS + 1), np.int64), []])
                entry[0] += 1
                counts = class_counts(raw.decode("utf-8", "replace"))[:CLASSES]
                if counts.sum():
                    entry[1][np.arange(CLASSES) * (BINS + 1) + counts * BINS // counts.sum()] += 1
                words, times = np.unique(word_hashes(raw, lower=True), return_counts=True)
                entry[2].append((words, times * UNIT // len(exact)))
                size += len(words)
            if size >= HELD:
                yield from told()
                held, size = {}, 0
    yield from told()


def language_references(docs: DataFrame) -> DataFrame:
    """lang, docs, classes (medians, in 1/1024), words (hashes), shares (in 2^-20 of a document) of each language of ``docs`` (lang, text as bytes).

    One more row, whose ``every`` is true, has the medians over all languages and no words.
    """
    sums = settle(docs.select("lang", "text").mapInArrow(_shares, "lang string, kind int, key long, value long").groupBy("lang", "kind", "key").agg(F.sum("value").alias("value")))
    number = sums.where("kind = 0").select("lang", F.col("value").alias("docs"))
    places = sums.where("kind = 1").select("lang", F.floor(F.col("key") / (BINS + 1)).cast("int").alias("class"), (F.col("key") % (BINS + 1)).alias("bin"), "value")
    every = F.lit(True).alias("every")
    places = places.select("*", F.lit(False).alias("every")).unionByName(places.groupBy("class", "bin").agg(F.sum("value").alias("value")).select(F.lit(None).cast("string").alias("lang"), "class", "bin", "value", every))
    so_far = Window.partitionBy("every", "lang", "class").orderBy("bin")
    whole = Window.partitionBy("every", "lang", "class")
    places = places.select("*", F.sum("value").over(so_far).alias("_upto"), F.sum("value").over(whole).alias("_all")).where("2 * _upto >= _all")
    medians = places.groupBy("every", "lang", "class").agg(F.min("bin").alias("median"))
    classes = F.transform(F.array_sort(F.collect_list(F.struct("class", "median"))), lambda x: x["median"].cast("int"))
    medians = medians.groupBy("every", "lang").agg(classes.alias("classes"))
    common = sums.where("kind = 2").join(number.withColumnRenamed("lang", "_l"), F.expr("lang <=> _l")).where(F.col("value") * COMMON >= F.col("docs") * UNIT)
    common = common.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", F.floor(F.col("value") / F.col("docs")).alias("share")))).alias("w"))
    common = common.select(F.col("lang").alias("_w"), F.col("w.key").alias("words"), F.col("w.share").alias("shares"))
    own = medians.where("not every").join(number.withColumnRenamed("lang", "_l"), F.expr("lang <=> _l")).join(common, F.expr("lang <=> _w"), "left")
    pooled = medians.where("every").select("every", "lang", F.lit(None).cast("long").alias("docs"), "classes", F.lit(None).cast("array<long>").alias("words"), F.lit(None).cast("array<long>").alias("shares"))
    return own.select("every", "lang", "docs", "classes", "words", "shares").unionByName(pooled)


def without_hot_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (lang, text) without texts that many rows of their language equal; there are fewer than a hundred a language."""
    grp = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    copies = docs.select(grp.alias("_grp"), F.xxhash64(grp, F.coalesce("text", F.lit(b""))).alias("_copy")).groupBy("_grp", "_copy").count()
    copies = settle(copies)
    rows = copies.groupBy("_grp").agg(F.sum("count").alias("_rows"))
    hot = settle(copies.where(f"count >= {LEAST_DOCS}").join(rows, "_grp").where("100 * count > _rows").select("_copy"))
    return docs.withColumn("_copy", F.xxhash64(grp, F.coalesce("text", F.lit(b"")))).join(hot, "_copy", "left_anti").drop("_copy")


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two histograms, each normalised first."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    bits = [float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum()) for x in (p, q)]
    return max(0.0, sum(bits) / 2) ** 0.5


def class_reference(medians: list[int]) -> np.ndarray:
    """Middles of the bins of the medians; a class that most documents lack has none."""
    m = np.array(medians, np.float64)
    return np.where(m > 0, 2 * m + 1, 0)


def verdict(raw: bytes, text: str, n_words: int, classes: np.ndarray | None, words: np.ndarray | None, shares: np.ndarray | None) -> tuple[float | None, float | None, bool]:
    """class_distance, word_distance (null where a guard holds) and whether both are within their limits."""
    near, far = None, None
    counts = class_counts(text)[:CLASSES]
    if classes is not None and counts.sum() >= LEAST_CHARS and classes.sum():
        near = jensen_shannon(counts.astype(np.float64), classes)
    if words is not None and len(words) and n_words >= LEAST_WORDS:
        own = word_hashes(raw, lower=True).view(np.int64)
        at = np.minimum(np.searchsorted(words, own), len(words) - 1)
        known = words[at] == own
        counted = np.bincount(at[known], minlength=len(words))
        far = jensen_shannon(np.append(counted, n_words - counted.sum()).astype(np.float64), np.append(shares, UNIT - shares.sum()).astype(np.float64))
    kept = (near is None or near <= CLASS_LIMIT) and (far is None or far <= WORD_LIMIT + WORD_NOISE / n_words**0.5)
    return near, far, kept


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, tuple] = {}
    for batch in batches:
        for part in sliced([batch], column=2, size=1 << 22):
            out = []
            for i, (lang, raw) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                if lang not in known:
                    classes, words, shares = (part.column(k)[i].as_py() for k in (3, 4, 5))
                    known[lang] = class_reference(classes) if classes else None, np.array(words, np.int64) if words else None, np.array(shares, np.int64) if words else None
                raw = raw or b""
                text = raw.decode("utf-8", "replace")
                base = base_counts(raw, text)
                failed = fails_base(base[0], base[4])
                near, far, kept = verdict(raw, text, base[0], *known[lang])
                out.append((*base, failed, kept and not failed, near, far))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = ["doc_id", *[f.split()[0] for f in RESULT.split(", ")]]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)]], names=names)


def judge_divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id and ``RESULT`` of every row: the base counts, the two distances and the verdict."""
    rows = pick(docs, doc_id=id_col, lang=lang_col, text=text_col)
    rows = rows.select("doc_id", F.col("lang").cast("string").alias("lang"), F.encode("text", "UTF-8").alias("text"))
    found = settle(language_references(without_hot_copies(rows.select("lang", "text"))))
    own = found.where(f"not every and docs >= {LEAST_DOCS}").select(F.col("lang").alias("_lang"), "classes", "words", "shares")
    pooled = found.where("every").agg(F.first("classes").alias("_classes"))
    # Spark sends the references to the texts while they are small, by their size; else it shuffles and splits large languages.
    joined = rows.join(own, F.expr("lang <=> _lang"), "left").crossJoin(pooled).select("doc_id", "lang", "text", F.coalesce("classes", "_classes").alias("classes"), "words", "shares")
    return joined.mapInArrow(_judge, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {RESULT}")
