"""The line field over long documents: run by run as line by line, and in linear time."""

import time

import numpy as np
import pytest

from scanledger.llm import quality


def random_field(rng):
    width = 3 * quality.OWN + 3
    return quality.LineField(rng.normal(size=width), rng.normal(size=(2, 2)), rng.normal(size=width) * 0.1, rng.uniform(0.5, 2, width))


def walked_line_by_line(field, emit):
    fore, back = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    for t, e in enumerate(emit):
        for j in (0, 1):
            fore[t, j] = (np.logaddexp(fore[t - 1, 0] + field.ties[0, j], fore[t - 1, 1] + field.ties[1, j]) if t else 0) + e * j
    for t in range(len(emit) - 2, -1, -1):
        for i in (0, 1):
            back[t, i] = np.logaddexp(field.ties[i, 0] + back[t + 1, 0], field.ties[i, 1] + emit[t + 1] + back[t + 1, 1])
    z = np.logaddexp(*fore[-1])
    pairs = sum(np.exp(fore[t][:, None] + field.ties + (back[t + 1] + [0, emit[t + 1]])[None] - z) for t in range(len(emit) - 1))
    return np.exp(fore[:, 1] + back[:, 1] - z), pairs, z


@pytest.mark.parametrize("run", [1, 3, 256])
def test_runs_give_what_single_lines_give(run, monkeypatch):
    monkeypatch.setattr(quality, "RUN", run)
    rng = np.random.default_rng(run)
    field, lines = random_field(rng), np.array([1, 7, 3, 1, 520, 2, 9, 6])
    emit = rng.normal(size=lines.sum()) * 3
    good, pairs, z = field.walked(emit, lines)
    each = [walked_line_by_line(field, e) for e in np.split(emit, np.cumsum(lines)[:-1])]
    assert np.allclose(good, np.concatenate([g for g, _, _ in each])) and np.allclose(pairs, sum(p for _, p, _ in each)) and np.isclose(z, sum(z for *_, z in each))


def test_pieces_of_texts_score_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(5)
    field = random_field(rng)
    texts = [b"", b"One line.", b"\n\n", "Fünf Wörter in einer Zeile.\nnoch eine 12 12 12!!\n".encode() * 40, b"a", b"x | y | z\n" * 7]
    x = quality.with_neighbours(np.concatenate([p for p, _ in quality.documents_features(texts)]), quality.line_counts(texts))
    good, _, _ = field.marginals(x, quality.line_counts(texts))
    weights = [np.array([max(len(line), 1) for line in t.split(b"\n")]) for t in texts]
    want = [(g * w).sum() / w.sum() for g, w in zip(np.split(good, np.cumsum(quality.line_counts(texts))[:-1]), weights, strict=True)]
    for lines, size in ((1 << 15, 1 << 20), (3, 50), (1, 1)):
        monkeypatch.setattr(quality, "CHUNK_LINES", lines)
        monkeypatch.setattr(quality, "CHUNK", size)
        assert np.allclose(quality.document_scores(field, texts), want)


def test_a_megabyte_of_line_feeds_takes_seconds():
    began = time.time()
    scores = quality.document_scores(random_field(np.random.default_rng(2)), [b"\n" * (1 << 20), b"A text."])
    assert len(scores) == 2 and time.time() - began < 10


def test_the_fit_is_bounded_in_lines_and_a_larger_row_takes_no_room(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a\n" * (9 if i else 5000)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_field", lambda x, lines, said: seen.append(lines.tolist()))
    quality.fit_quality(docs, labels, most_lines=100)
    assert seen == [[10] * 10]
