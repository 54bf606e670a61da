import tracemalloc

import numpy as np
import pytest

from tessera.llm import gru, langid

from .helpers import frame


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in gru.initial_weights(3, 4, 1).items()}
    data = rng.integers(97, 110, (7, 5))
    data[5:, 2] = gru.PAD
    labels = rng.integers(0, 3, 5)
    _, g = gru.gradients(w, data, labels)
    for k in w:
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w[k].shape)
            if k[0] == "x":
                at = (at[0], int(data[0, 0]))
            change = {}
            for e in (1e-2, -1e-2):
                moved = {n: v.copy() for n, v in w.items()}
                moved[k][at] += e
                change[e] = gru.gradients(moved, data, labels)[0]
            slope = (change[1e-2] - change[-1e-2]) / 2e-2
            assert abs(slope - g[k][at]) < 2e-3 + 0.05 * abs(slope), (k, at, slope, g[k][at])


def test_training_separates_two_alphabets():
    rng = np.random.default_rng(1)
    labels = np.repeat([0, 1], 40)
    data = np.where(labels[None, :] == 0, rng.integers(97, 110, (20, 80)), rng.integers(105, 120, (20, 80)))
    w = gru.train(data, labels, 2, 4, 6, 16, 3)
    p = gru.probabilities(w, data).mean(axis=1)
    assert (p.argmax(axis=0) == labels).mean() > 0.95
    assert np.allclose(p.sum(axis=0), 1, atol=1e-4)


def naive(w, text):
    """Probabilities of each position, byte by byte and unit by unit, over the whole text."""
    n = w["uf"].shape[1]
    squash = lambda v: v / (1 + abs(v))
    states = {}
    for d in "fb":
        x, u, b = (w[k + d].astype(float) for k in "xub")
        h, states[d] = [0.0] * n, {}
        for t in range(len(text)) if d == "f" else reversed(range(len(text))):
            m = [sum(u[i][j] * h[j] for j in range(n)) + b[i][0] for i in range(3 * n)]
            z = [(1 + squash(x[i][text[t]] + m[i])) / 2 for i in range(n)]
            r = [(1 + squash(x[n + i][text[t]] + m[n + i])) / 2 for i in range(n)]
            c = [squash(x[2 * n + i][text[t]] + m[2 * n + i] * r[i]) for i in range(n)]
            h = states[d][t] = [z[i] * h[i] + (1 - z[i]) * c[i] for i in range(n)]
    out = []
    for t in range(len(text)):
        both = states["f"][t] + states["b"][t]
        e = np.exp([sum(v * s for v, s in zip(row, both, strict=True)) + c[0] for row, c in zip(w["v"].astype(float), w["c"], strict=True)])
        out.append(e / e.sum())
    return np.array(out)


def test_pooled_labels_equal_those_of_a_naive_recurrence(monkeypatch):
    """Short texts and edges exactly; chunks with a lead of other bytes as nearly as states forget."""
    rng = np.random.default_rng(5)
    labels = np.repeat([0, 1, 2], 60)
    base = np.array([97, 103, 109])[labels]
    w = gru.train(base[None, :] + rng.integers(0, 12, (40, 180)), labels, 3, 6, 4, 16, 3)
    draw = lambda n: bytes((rng.choice([97, 103, 109]) + rng.integers(0, 12, n)).astype(np.uint8))
    texts = [b"", b"a", draw(63), draw(langid.CHUNK), draw(langid.CHUNK + 1), b"".join(draw(200) for _ in range(8)), draw(30)]
    for chunks in (2, 1000):
        monkeypatch.setattr(langid, "CHUNKS", chunks)
        pooled, labelled = langid._pooled(w, texts)
        assert not pooled[0].any() and not labelled[0].any()
        for k, text in enumerate(texts):
            if text:
                p = naive(w, text)
                close = 1e-4 if len(text) <= langid.CHUNK else 1e-3
                assert np.abs(pooled[k] - p.mean(axis=0)).max() < close
                assert np.abs(labelled[k] - np.bincount(p.argmax(axis=1), minlength=3) / len(text)).max() <= (1e-9 if len(text) <= langid.CHUNK else 2e-3)


def test_memory_does_not_grow_with_languages():
    text = [b"some words of a text " * 13_000]
    peaks = {}
    for classes in (4, 200):
        w = gru.initial_weights(classes, langid.HIDDEN, 1)
        tracemalloc.start()
        pooled, _ = langid._pooled(w, text)
        peaks[classes] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert np.isclose(pooled.sum(), 1, atol=1e-3)
    assert peaks[200] < 150e6, peaks


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    docs = frame(spark, [(4 * k, "a text of letters", f"l{k % 5}", "s", 0) for k in range(40)])
    with pytest.raises(ValueError, match="5 values"):
        langid.fit_languages(docs)
