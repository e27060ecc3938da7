"""Reading levels work on numbers of words: a word is looked up once, not at each of its occurrences."""

import math
import pickle
import re

import numpy as np
import pytest

from corpusmill.llm import reading

TEXTS = ["The king; the KING, 12 ships... and\nDavid's… Zz_9!", "", None, " \n.", "…;", "naïve ÄB w1 w2 w3. w4 w5", "end", "e.g. the king. the king. the king"]


def plain(text):
    """Words and inner marks of each sentence, one sentence after another."""
    return [s for s in (re.findall(r"\w+|[,;:]", s) for s in re.findall(r"[^.!?…\n]+", text or "")) if s]


def labelled(n=90):
    random = np.random.default_rng(3)
    out = []
    for i in range(n):
        hard = i % 3 == 0
        words = [f"W{random.integers(60)}x" if hard else f"w{random.integers(12)}" for _ in range(40)]
        out.append((" ".join(w + ("." if j % (11 if hard else 4) == 3 else ",") for j, w in enumerate(words)), 1 + 2 * hard + i % 2))
    return out


def words_of(texts, names):
    return [[[names[i] for i in texts.words[texts.starts[s] : texts.starts[s + 1]]] for s in range(texts.docs[d], texts.docs[d + 1])] for d in range(len(texts))]


@pytest.mark.parametrize("at_once", [1, 3, 256])
def test_texts_are_cut_as_before(monkeypatch, at_once):
    monkeypatch.setattr(reading, "SCORED_AT_ONCE", at_once)
    whole = reading.corpus_of(TEXTS)
    assert words_of(whole.texts, whole.names) == [plain(t) for t in TEXTS]
    assert words_of(whole.take(np.array([7, 1, 0])).texts, whole.names) == [plain(TEXTS[i]) for i in (7, 1, 0)]
    cut = reading.corpus_of_sentences([plain(t) for t in TEXTS])
    assert words_of(cut.texts, cut.names) == [plain(t) for t in TEXTS]
    assert len(reading.corpus_of([])) == 0


def test_a_word_is_looked_up_once(monkeypatch):
    """With a look-up for every occurrence of a rare word in each of five models there were thousands."""
    asked = []
    monkeypatch.setattr(reading, "word_class", lambda w, real=reading.word_class: asked.append(w) or real(w))
    documents = [(plain(t), b) for t, b in labelled()]
    model = reading.train(documents, reading.ReadingConfig(least_count=30))
    distinct = {w for d, _ in documents for s in d for w in s}
    assert sorted(asked) == sorted(distinct)
    asked.clear()
    reading._scores([d for d, _ in documents], model)
    assert len(asked) <= len(distinct)


def test_places_are_those_of_a_search():
    random = np.random.default_rng(1)
    for n in (0, 1, 7, 5_000):
        keys = np.unique(random.integers(0, 10**13, n))
        asked = np.concatenate([random.permutation(keys), random.integers(0, 10**13, 999)])
        want = [int(i) if i < len(keys) and keys[i] == k else len(keys) for i, k in zip(np.searchsorted(keys, asked), asked, strict=True)]
        assert reading.Places(keys).of(asked).tolist() == want


def test_difficulties_are_those_of_sums_word_by_word():
    documents = labelled()
    corpus = reading.corpus_of([t for t, _ in documents])
    model = reading.train_corpus(corpus, np.array([b for _, b in documents]), reading.ReadingConfig())
    two, three, size = dict(zip(model.keys.tolist(), model.two)), dict(zip(model.long_keys.tolist(), model.three)), len(model.known)
    assert two and three and len(model.columns) > len(model.bands)
    texts = [*(t for t, _ in documents[:25]), *TEXTS]
    got = reading.difficulties(reading.numbered(texts, reading.Numbers(model.number, 5)), model)
    for text, found in zip(texts, got, strict=True):
        rows = []
        for sentence in plain(text):
            ids = [model.known.get(f"<length {int(2 * math.log2(len(sentence)))}>", 0)]
            ids += [model.known.get(w.lower(), model.known.get(reading.word_class(w), 0)) for w in sentence]
            bits = np.zeros(len(model.columns))
            for i, x in enumerate(ids):
                a, b = (ids[i - 1] if i else 0), (ids[i - 2] if i > 1 else 0)
                p = model.one[x].astype(float)
                if a * size + x in two:
                    p = p + two[a * size + x] + three.get((b * size + a) * size + x, 0)
                bits -= np.log2(p)
            rows.append((len(sentence), np.array([min(bits[j] for j, c in enumerate(model.columns) if c == band) for band in model.bands])))
        if not rows:
            assert found[0] == 0 and np.isnan(found[1:]).all()
            continue
        words, bits = np.array([n for n, _ in rows], dtype=float), np.stack([b for _, b in rows])
        share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
        share /= share.sum(axis=1, keepdims=True)
        level = share @ np.array(model.bands, dtype=float)
        order = np.argsort(level, kind="stable")
        middle = level[order][np.searchsorted(np.cumsum(words[order]) / words.sum(), [0.4, 0.5, 0.6])].mean()
        want = [words.sum(), 0.75 * middle + 0.25 * (words @ level) / words.sum(), words @ share[:, -1] / words.sum(), bits.min(axis=1).sum() / (words + 1).sum()]
        assert np.allclose(found, want, rtol=1e-4, atol=1e-4)


def test_a_model_travels_without_its_zeros():
    documents = labelled()
    model = reading.train([(plain(t), b) for t, b in documents], reading.ReadingConfig())
    model.two = np.vstack([model.two, np.zeros((20_000, model.two.shape[1]), dtype=np.float32)])
    want = reading._scores([plain(t) for t, _ in documents], model)  # makes the places, which stay here
    packed = pickle.dumps(model)
    assert len(packed) < model.two.nbytes / 10
    again = pickle.loads(packed)
    assert "places" not in again.__dict__ and (again.two == model.two).all() and (again.three == model.three).all()
    assert (reading._scores([plain(t) for t, _ in documents], again) == want).all()


def test_training_counts_documents_by_parts(monkeypatch):
    """The words of all labelled documents are never widened at once, and the model doesn't depend on the parts."""
    documents = [(plain(t), b) for t, b in labelled()]
    whole = reading.train(documents, reading.ReadingConfig())
    seen = []
    real = reading.BandModels.with_lengths
    monkeypatch.setattr(reading.BandModels, "with_lengths", lambda model, texts: seen.append(len(texts)) or real(model, texts))
    monkeypatch.setattr(reading, "COUNTED_AT_ONCE", 7)
    monkeypatch.setattr(reading, "SCORED_AT_ONCE", 5)
    parts = reading.train(documents, reading.ReadingConfig())
    assert max(seen) == 7
    assert parts.known == whole.known and parts.weights == whole.weights and parts.columns == whole.columns
    assert all((getattr(parts, n) == getattr(whole, n)).all() for n in ("one", "keys", "two", "long_keys", "three"))
