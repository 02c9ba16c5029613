"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad.  Its features are counts and shares of its own characters and words and those of the lines
before and after it; two-by-two transition scores tie neighbouring lines together.  Forward-backward gives each line's
marginal probability of being good, and a document's score is their mean weighted by line length.  The field is fitted
by gradient steps on its conditional log-likelihood, each line of a labelled document carrying the document's label.

Defined results: a null or empty text is one empty line and gets the score of that; a line without characters weighs 1;
without any labelled row every score is 0.5; repeated rows get equal scores; labels that disagree on a document are
averaged down to the smaller one; a row without a doc_id is scored like any other and has a null held_out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, pick, settle, sliced
from .words import word_hashes

#: Most labelled rows that the field is fitted on: those with the smallest hash of their id.
FIT_ROWS = 4000
#: Most bytes of text and most lines among them: what of them comes behind in that order is left out, and a row that is
#: larger by itself.  A line's features take 192 bytes in the driver.
FIT_BYTES, FIT_LINES = 64 << 20, 500_000
STEPS = 250
THRESHOLD = 0.3
#: Bytes and lines whose features are made together.
CHUNK, CHUNK_LINES = 1 << 20, 1 << 15
#: Lines of a document that are walked one after the other; its runs of so many are walked side by side.
RUN = 256
SLICE_BYTES = 1 << 20

_KINDS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 sentence mark, 5 '!' or '?', 6 bar, 7 other ASCII mark, 8 not ASCII, 9 space
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 3, 8
for _c in range(33, 127):
    _KINDS[_c] = _KINDS[_c] or (4 if chr(_c) in ".,;:'\"()-" else 5 if chr(_c) in "!?" else 6 if chr(_c) == "|" else 7)
_KINDS[[9, 10, 11, 12, 13, 32]] = 9
OWN = 15


def line_features(buffer: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and byte lengths of the lines of ``buffer``, each ended by a line feed, that begin at ``starts``."""
    b = np.frombuffer(buffer, np.uint8)
    kinds = _KINDS[b]
    ends = np.append(starts[1:], len(b)) - 1
    length = (ends - starts).astype(np.float64)
    per = [np.add.reduceat((kinds == k).astype(np.int32), starts).astype(np.float64) for k in range(1, 10)]
    upper, lower, digit, mark, shout, bar, odd, wide, _ = per
    inside = kinds != 9
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    words = np.add.reduceat(first.astype(np.int32), starts).astype(np.float64)
    # A word equal to the one before it in the line.
    line_of = np.searchsorted(starts, np.flatnonzero(first), side="right") - 1
    h = word_hashes(buffer)
    again = np.zeros(len(starts))
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
        again = np.bincount(line_of[1:][same], minlength=len(starts)).astype(np.float64)
    upper_first = np.zeros(len(starts))
    at = np.flatnonzero(first)
    np.add.at(upper_first, line_of, (kinds[at] == 1).astype(np.float64))
    w, n, letters = np.maximum(words, 1), np.maximum(length, 1), np.maximum(upper + lower, 1)
    last = b[np.maximum(ends - 1, 0)]
    x = np.stack(
        [upper / letters, upper_first / w, digit / n, mark / w, np.minimum(shout / w, 3), np.minimum(bar / w, 3), np.minimum(odd / w, 4), wide / n, again / w, np.log1p(words), np.log1p(length), length / w / 10, (last == 46) & (length > 0), length == 0, np.minimum(again, 20) / 20],
        axis=1,
    ).astype(np.float64)
    return x, length


def documents_features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Own features and lengths of the lines of all texts, in order, in pieces of about ``CHUNK`` bytes or ``CHUNK_LINES`` lines.

    A piece may hold several texts or end within one, behind a line.
    """
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        buffer = b"\n".join(texts[i:j]) + b"\n"
        ends = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10) + 1
        done = line = 0
        while line < len(ends):
            stop = min(line + CHUNK_LINES, max(int(np.searchsorted(ends, done + CHUNK, side="right")), line + 1))
            begins = np.append(done, ends[line : stop - 1])
            yield line_features(buffer[done : int(ends[stop - 1])], begins - done)
            done, line = int(ends[stop - 1]), stop
        i = j


def line_counts(texts: list[bytes]) -> np.ndarray:
    return np.array([t.count(b"\n") + 1 for t in texts], np.int64)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's own features, those of the line before and after it in its document, and whether there is none."""
    first = np.zeros(len(x), bool)
    first[np.cumsum(lines)[:-1]] = True
    first[:1] = True
    last = np.append(first[1:], True)
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1)


@dataclass
class LineField:
    """Emission weights of the good state, transition scores, and the scaling of the features."""

    weights: np.ndarray
    ties: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What lines' own features add to the score of a line itself, of the one after it and of the one before it."""
        w = self.weights / self.scale
        return x @ np.stack([w[k * OWN : (k + 1) * OWN] for k in range(3)], axis=1)

    def emissions(self, parts: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """What the good state of each line scores, from ``projected``: the same as scaling and weighing ``with_neighbours``."""
        w, ends = self.weights / self.scale, np.cumsum(lines)
        out = parts[:, 0] + w[3 * OWN + 2] - self.mean @ w
        before, after = np.append(0.0, parts[:-1, 1]), np.append(parts[1:, 2], 0.0)
        before[ends - lines], after[ends - 1] = w[3 * OWN], w[3 * OWN + 1]
        return out + before + after

    def marginals(self, x: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line, the expected count of each transition, and the sum of log partition functions."""
        return self.walked(((x - self.mean) / self.scale) @ self.weights, lines)

    def walked(self, emit: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Forward and backward over documents of ``lines`` lines each, one at least.

        Documents are cut into runs of ``RUN`` lines.  What a run makes of either state before it is a matrix of two by two;
        from those of a document's runs follow the messages that enter each run from both sides, and all runs are then
        walked at once.
        """
        if not len(lines):
            return np.zeros(0), np.zeros((2, 2)), 0.0
        runs = -(-lines // RUN)
        of_doc = np.repeat(np.arange(len(lines)), runs)
        nth = np.arange(len(of_doc)) - np.repeat(np.cumsum(runs) - runs, runs)
        begin = (np.cumsum(lines) - lines)[of_doc] + nth * RUN
        size = np.minimum(lines[of_doc] - nth * RUN, RUN)
        order = np.argsort(-size, kind="stable")
        begin_by, live = begin[order], np.searchsorted(-size[order], -np.arange(RUN + 1), side="left")  # runs with more than t lines
        t00, t01, t10, t11 = self.ties.ravel()

        def over(m: np.ndarray) -> np.ndarray:
            """Messages about a line, as messages into the next."""
            return np.stack([np.logaddexp(m[:, 0] + t00, m[:, 1] + t10), np.logaddexp(m[:, 0] + t01, m[:, 1] + t11)], axis=1)

        def back_over(m: np.ndarray) -> np.ndarray:
            return np.stack([np.logaddexp(t00 + m[:, 0], t01 + m[:, 1]), np.logaddexp(t10 + m[:, 0], t11 + m[:, 1])], axis=1)

        def forward(entry: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
            """Messages about the last line of each run."""
            now = entry[order].copy()
            for t in range(int(size.max())):
                k = live[t]
                if t:
                    now[:k] = over(now[:k])
                now[:k, 1] += emit[begin_by[:k] + t]
                if keep is not None:
                    keep[begin_by[:k] + t] = now[:k]
            out = np.empty_like(now)
            out[order] = now
            return out

        entry, leave = np.zeros((len(begin), 2)), np.zeros((len(begin), 2))
        if len(begin) > len(lines):
            columns = [forward(np.tile(unit, (len(begin), 1)), None) for unit in ((0.0, -np.inf), (-np.inf, 0.0))]
            for k in range(1, int(runs.max())):
                at = np.flatnonzero(nth == k)
                was = entry[at - 1]
                entry[at] = over(np.stack([np.logaddexp(columns[0][at - 1, j] + was[:, 0], columns[1][at - 1, j] + was[:, 1]) for j in (0, 1)], axis=1))
            for k in range(int(runs.max()) - 1, 0, -1):
                at = np.flatnonzero(nth == k)
                leave[at - 1] = back_over(np.stack([np.logaddexp(columns[j][at, 0] + leave[at, 0], columns[j][at, 1] + leave[at, 1]) for j in (0, 1)], axis=1))
        fore, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        forward(entry, fore)
        back[begin + size - 1] = leave
        for t in range(int(size.max()) - 2, -1, -1):
            at = begin_by[: live[t + 1]] + t
            ahead = back[at + 1]
            ahead[:, 1] += emit[at + 1]
            back[at] = back_over(ahead)
        ends = np.cumsum(lines) - 1
        z = np.logaddexp(fore[ends, 0], fore[ends, 1])
        of_line = np.repeat(z, lines)
        within = np.ones(len(emit), bool)
        within[ends] = False
        at = np.flatnonzero(within)
        ahead = back[at + 1]
        ahead[:, 1] += emit[at + 1]
        pairs = np.array([[np.exp(fore[at, i] + self.ties[i, j] + ahead[:, j] - of_line[at]).sum() for j in (0, 1)] for i in (0, 1)])
        return np.clip(np.exp(fore[:, 1] + back[:, 1] - of_line), 0, 1), pairs, float(z.sum())


def fit_field(x: np.ndarray, lines: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> LineField:
    """Fit by Adam on the mean log-likelihood per line, with a small quadratic penalty.

    Transition scores keep below a bound through the penalty: within a labelled document all lines share a label.
    """
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[-1], scale = 0.0, np.where(scale < 1e-6, 1.0, scale)
    field = LineField(np.zeros(x.shape[1]), np.zeros((2, 2)), mean, scale)
    if not len(lines):
        return field
    z = (x - mean) / scale
    of_line = np.repeat(labels, lines).astype(np.float64)
    same = np.zeros((2, 2))
    for k in (0, 1):
        same[k, k] = (lines - 1)[labels == k].sum()
    moments = [np.zeros(len(field.weights)), np.zeros(len(field.weights)), np.zeros((2, 2)), np.zeros((2, 2))]
    n = len(x)
    for step in range(1, steps + 1):
        good, pairs, _ = field.marginals(x, lines)
        grads = (z.T @ (of_line - good) / n - 1e-4 * field.weights, (same - pairs) / n - 0.02 * field.ties)
        rate = 0.1 * (1 - step / (steps + 1))
        for i, (target, g) in enumerate(((field.weights, grads[0]), (field.ties, grads[1]))):
            m, v = moments[2 * i], moments[2 * i + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            target += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return field


def in_test(doc_id: str) -> Column:
    """Whether a row is held out of fitting: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, size: int = FIT_BYTES, most_lines: int = FIT_LINES) -> LineField:
    """The field fitted on at most ``rows`` labelled rows of ``size`` bytes and ``most_lines`` lines together that are not held
    out; their features come to the driver.

    Of rows with the same doc_id, the smallest text is taken; a row larger than either bound by itself is left out.
    """
    known = pick(labels, doc_id=id_col, label=label_col).where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    drawn = known.where(~in_test("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(drawn), "doc_id")  # ``rows`` rows at most
    texts = settle(texts.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    bytes_of, lines_of = F.octet_length("text") + 1, F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = texts.select("doc_id", bytes_of.cast("long").alias("bytes"), lines_of.cast("long").alias("lines")).where((F.col("bytes") <= size) & (F.col("lines") <= most_lines))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over sizes alone
    fits = sizes.select("doc_id", F.sum("bytes").over(order).alias("b"), F.sum("lines").over(order).alias("l")).where((F.col("b") <= size) & (F.col("l") <= most_lines))
    chosen = texts.join(F.broadcast(fits.select("doc_id")), "doc_id").select("label", F.encode("text", "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            said = [t or b"" for t in batch.column(1).to_pylist()]
            lines = line_counts(said)
            x = with_neighbours(np.concatenate([part.astype(np.float32) for part, _ in documents_features(said)]), lines)
            parts = [p.astype(np.float32).tobytes() for p in np.split(x, np.cumsum(lines)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(parts, pa.binary())], names=["label", "x"])

    got = sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(run, "label int, x binary").collect())
    discard(texts)
    width = 3 * OWN + 3
    parts = [np.frombuffer(p, np.float32).reshape(-1, width).astype(np.float64) for _, p in got]
    x = np.concatenate(parts) if parts else np.zeros((0, width))
    if not len(parts):
        return LineField(np.zeros(width), np.zeros((2, 2)), np.zeros(width), np.ones(width))
    return fit_field(x, np.array([len(p) for p in parts]), np.array([k for k, _ in got]))


def document_scores(field: LineField, texts: list[bytes]) -> np.ndarray:
    """The length-weighted mean of the marginals of each text's lines."""
    if not texts:
        return np.zeros(0)
    lines, parts = line_counts(texts), [(field.projected(x), length) for x, length in documents_features(texts)]
    good, _, _ = field.walked(field.emissions(np.concatenate([p for p, _ in parts]), lines), lines)
    weight = np.maximum(np.concatenate([n for _, n in parts]), 1)
    begins = np.cumsum(lines) - lines
    return np.clip(np.add.reduceat(good * weight, begins) / np.add.reduceat(weight, begins), 0, 1)


def score_quality(docs: DataFrame, field: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row."""
    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.encode("text", "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=1, size=SLICE_BYTES):
            scores = document_scores(field, [t or b"" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, field: LineField, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, column=at, size=SLICE_BYTES):
            yield batch.filter(pa.array(document_scores(field, [(t or "").encode() for t in batch.column(at).to_pylist()]) >= least))

    return docs.mapInArrow(run, docs.schema)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    field = fit_quality(docs, labels)
    scored = score_quality(docs, field)
    return scored.select("doc_id", in_test("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
