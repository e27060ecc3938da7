"""Reading level of documents from n-gram surprisal and isotonic regression.

For each band of the labelled sample an interpolated n-gram model is trained (three-word, two-word, one-word and
uniform parts, weighted by how often each predicts best a word left out of the counts; rare words stand as classes of
ending and length, capitalised rare words as names, and a sentence's length is a token of its own). A band's model is a set of components, one per kind of text found among its documents, so that a text can be
demanding by its vocabulary or by its sentences in any language; documents that models trained on others assign to a
wrong band make up a further component of their band. Every sentence of every document is scored in full under each band's model: its surprisals give the
probability of each band and so a difficulty between the lowest and the highest. A document's difficulty is read from
the distribution over its text, weighted by words: the middle of the distribution counts most, since a document is as
demanding as most of its text. Isotonic regression maps difficulty to the graded bands; it is fitted on scores that
models trained without the document gave. The models of all folds are trained on executors, one task each.
"""

from __future__ import annotations

import math
import pickle
import re
import sys
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import spread

#: Words and inner marks, and the marks between sentences.
PIECE = re.compile(r"\w+|[,;:]|[.!?…\n]+")
BETWEEN = frozenset(".!?…\n")
#: Words whose numbers a task holds.
HELD_WORDS = 200_000
#: Documents whose sentences are scored at once, and whose word sequences are counted at once.
SCORED_AT_ONCE, COUNTED_AT_ONCE = 256, 4_096
#: Labelled items up to which their ids are sent to the texts.
BROADCAST_LABELS = 500_000


@dataclass(frozen=True)
class ReadingConfig:
    """``labelled_rows`` and ``labelled_chars`` bound the labelled documents that a task trains on, by default all;
    ``vocabulary``, ``two_words`` and ``three_words`` bound the models that the driver and each task hold."""

    labelled_rows: int | None = None
    labelled_chars: int | None = None
    vocabulary: int = 30_000
    two_words: int = 400_000
    three_words: int = 200_000
    least_count: int = 3
    folds: int = 3
    components: int = 6
    component_documents: int = 12
    residual_documents: int = 4
    weight_uniform: float = 0.03
    evidence: float = 1.0


def word_class(word: str) -> str:
    """The class that stands for a rare word."""
    if word[:1].isdigit():
        return "<number>"
    if word[:1].isupper() and not word[1:2].isupper():
        return f"<name {min(len(word) // 8, 2)}>"
    return f"<{word[-3:].lower()} {min(len(word) // 4, 5)}>"


class Numbers(dict):
    """The numbers of pieces: ``number(word)``, asked once for each of at most ``most`` distinct ones, and -1 between sentences."""

    def __init__(self, number: Callable[[str], int], most: int = HELD_WORDS):
        self.number, self.most = number, most

    def __missing__(self, piece: str) -> int:
        found = -1 if piece[0] in BETWEEN else self.number(piece)
        if len(self) < self.most:
            self[piece] = found
        return found


@dataclass
class Texts:
    """Documents as numbers of words: sentence i is ``words[starts[i]:starts[i + 1]]``, none is empty, and document i has the sentences from ``docs[i]`` to ``docs[i + 1]``."""

    words: np.ndarray
    starts: np.ndarray
    docs: np.ndarray

    def __len__(self) -> int:
        return len(self.docs) - 1

    def take(self, which: np.ndarray) -> Texts:
        """The documents at these places."""
        sizes, docs = np.diff(self.starts), [(self.docs[i], self.docs[i + 1]) for i in which]
        words = np.concatenate([self.words[:0], *(self.words[self.starts[a] : self.starts[b]] for a, b in docs)])
        sizes = np.concatenate([sizes[:0], *(sizes[a:b] for a, b in docs)])
        return Texts(words, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([[0], np.cumsum([b - a for a, b in docs], dtype=np.int64)]))

    def parts(self, at_once: int | None = None):
        """The documents, ``SCORED_AT_ONCE`` at a time unless told otherwise."""
        step = at_once or SCORED_AT_ONCE
        for at in range(0, len(self), step):
            docs = self.docs[at : at + step + 1]
            starts = self.starts[docs[0] : docs[-1] + 1]
            yield Texts(self.words[starts[0] : starts[-1]], starts - starts[0], docs - docs[0])


def numbered(texts: list[str | None], numbers: Numbers) -> Texts:
    """The words and inner marks of each sentence of each text, as numbers."""
    found = [PIECE.findall(t) if t else [] for t in texts]
    owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(found)), np.int64, len(owner))
    word = flat >= 0
    begins = word.copy()
    begins[1:] &= ~word[:-1] | (owner[1:] != owner[:-1])
    begins = np.flatnonzero(begins)
    before = np.cumsum(word)
    starts = np.append(before[begins] - 1, before[-1:] if len(before) else 0)
    return Texts(flat[word].astype(np.int32), starts, np.concatenate([[0], np.cumsum(np.bincount(owner[begins], minlength=len(found)))]))


def _joined(parts: list[Texts]) -> Texts:
    """Documents one after another."""
    words, sentences = (np.cumsum([0, *sizes]) for sizes in ([len(p.words) for p in parts], [len(p.starts) - 1 for p in parts]))
    starts = [p.starts[:-1] + n for p, n in zip(parts, words, strict=False)]
    docs = [p.docs[:-1] + n for p, n in zip(parts, sentences, strict=False)]
    return Texts(np.concatenate([np.zeros(0, np.int32), *(p.words for p in parts)]), np.append(np.concatenate([np.zeros(0, np.int64), *starts]), words[-1]), np.append(np.concatenate([np.zeros(0, np.int64), *docs]), sentences[-1]))


@dataclass
class Corpus:
    """Labelled documents whose words are numbers of ``names``, the distinct words."""

    texts: Texts
    names: list[str]
    classes: list[str]
    lower: np.ndarray  # the place of a name's lower case in ``lowers``
    lowers: list[str]

    def __len__(self) -> int:
        return len(self.texts)

    def take(self, which: np.ndarray) -> Corpus:
        return replace(self, texts=self.texts.take(which))


def _named(cut: Callable[[Numbers], Texts]) -> Corpus:
    names: list[str] = []
    numbers = Numbers(lambda word: names.append(word) or len(names) - 1, sys.maxsize)
    texts = cut(numbers)
    lowers: dict[str, int] = {}
    lower = np.array([lowers.setdefault(w.lower(), len(lowers)) for w in names], dtype=np.int64)
    return Corpus(texts, names, [word_class(w) for w in names], lower, list(lowers))


def corpus_of(texts: list[str]) -> Corpus:
    """The corpus of whole texts, some at a time."""
    return _named(lambda numbers: _joined([numbered(texts[at : at + SCORED_AT_ONCE], numbers) for at in range(0, len(texts), SCORED_AT_ONCE)]))


def corpus_of_sentences(documents: list[list[list[str]]]) -> Corpus:
    """The corpus of documents that are cut into sentences and words already."""
    sentences = [s for d in documents for s in d if s]

    def cut(numbers: Numbers) -> Texts:
        words = np.array([numbers[w] for s in sentences for w in s], dtype=np.int32)
        return Texts(words, np.cumsum([0, *map(len, sentences)]), np.cumsum([0, *(sum(map(bool, d)) for d in documents)]))

    return _named(cut)


def length_class(words: int) -> str:
    """The class of a sentence's length."""
    return f"<length {int(2 * math.log2(words))}>"


class Places:
    """The places of distinct keys, none of which is negative, found by hashing: a binary search among many is slower."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, -1)  # the place of a key that isn't there
        self.bits = max(2 * len(keys), 2).bit_length()
        self.slots = np.full(1 << self.bits, len(keys), dtype=np.int32)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = self.slots[slot] == len(keys)
            self.slots[slot[free]] = todo[free]
            left = self.slots[slot] != todo
            todo, slot = todo[left], (slot[left] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = np.take(self.slots, slot)
        none = len(self.keys) - 1
        wrong = np.flatnonzero((np.take(self.keys, found) != keys) & (found < none))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) % len(self.slots)
            found[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(self.keys[found[wrong]] != keys[wrong]) & (found[wrong] < none)]
        return found


@dataclass
class BandModels:
    """Interpolated n-gram models of all bands over one vocabulary."""

    bands: list[int]
    columns: list[int] = field(default_factory=list)  # the band of each component
    known: dict[str, int] = field(default_factory=dict)
    one: np.ndarray | None = None  # weighted probabilities with the uniform part, word x component
    keys: np.ndarray | None = None  # sorted two-word keys
    two: np.ndarray | None = None  # weighted probabilities after the first word, key x component, and zeros for other keys
    long_keys: np.ndarray | None = None  # sorted three-word keys
    three: np.ndarray | None = None  # weighted probabilities after the first two words, key x component, and zeros for other keys
    weights: tuple[float, float, float] = (0.37, 0.6, 0.0)  # of one, two and three words
    config: ReadingConfig = field(default_factory=ReadingConfig)

    def __getstate__(self) -> dict:
        """Without the zeros of the large tables, which are nearly all of them, and without what is made again."""
        state = {k: v for k, v in self.__dict__.items() if k != "places"}
        for name in ("two", "three"):
            table = state[name]
            if table is not None:
                at = np.flatnonzero(table)
                state[name] = table.shape, at.astype(np.uint32 if table.size < 1 << 32 else np.int64), table.ravel()[at]
        return state

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for name in ("two", "three"):
            if state[name] is not None:
                shape, at, values = state[name]
                table = np.zeros(shape, dtype=np.float32)
                table.ravel()[at] = values
                self.__dict__[name] = table

    def number(self, word: str) -> int:
        found = self.known.get(word.lower())
        return self.known.get(word_class(word), 0) if found is None else found

    def own_numbers(self, corpus: Corpus) -> Texts:
        """The documents of a corpus in the model's numbers."""
        known = self.known.get
        lowers = np.array([known(w, -1) for w in corpus.lowers], dtype=np.int32)[corpus.lower]
        classes = np.array([known(c, 0) for c in corpus.classes], dtype=np.int32)
        return replace(corpus.texts, words=np.where(lowers < 0, classes, lowers)[corpus.texts.words])

    def with_lengths(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All words in a row, each sentence after the number of its length, and where sentences begin."""
        sizes, own = np.unique(np.diff(texts.starts), return_inverse=True)
        starts = texts.starts[:-1] + np.arange(len(own))
        flat = np.empty(len(texts.words) + len(own), dtype=np.int64)
        rest = np.ones(len(flat), dtype=bool)
        rest[starts] = False
        flat[rest] = texts.words
        flat[starts] = np.array([self.known.get(length_class(n), 0) for n in sizes], dtype=np.int64)[own]
        return flat, starts

    @cached_property
    def places(self) -> tuple[Places, Places]:
        return Places(self.keys), Places(self.long_keys)

    def surprisal(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each sentence under each component; ``flat`` holds ids, sentences begin at ``starts``."""
        size = len(self.known)
        before, further = _before(flat, starts)
        p = np.take(self.one, flat, axis=0)
        pair, triple = self.places
        found = pair.of(before * size + flat)
        p += np.take(self.two, found, axis=0)
        if len(self.long_keys):
            at = np.flatnonzero(found < len(self.keys))  # three words are known only where the last two are
            long = np.full(len(flat), len(self.long_keys))
            long[at] = triple.of(((further * size + before) * size + flat)[at])
            p += np.take(self.three, long, axis=0)
        return -np.add.reduceat(np.log2(p, out=p), starts, axis=0)


def _before(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each and the one before that; 0 before a sentence."""
    flat = flat.astype(np.int64)
    before, further = np.concatenate([[0], flat[:-1]]), np.concatenate([[0, 0], flat[:-2]])
    before[starts] = 0
    further[starts] = 0
    second = starts + 1
    further[second[second < len(flat)]] = 0
    return before, further


def fitted_weights(one: np.ndarray, two: np.ndarray, three: np.ndarray, after_one: np.ndarray, after_two: np.ndarray, total: np.ndarray, often: np.ndarray) -> tuple[float, float, float]:
    """Weights of one-, two- and three-word parts: the share of words that each predicts best when left out.

    All arguments are counts per distinct three-word cell: of the word, the last two, all three, the contexts of both,
    all words of the component, and how often the cell occurs.
    """

    def left_out(count: np.ndarray, of: np.ndarray) -> np.ndarray:
        return (count - 1) / np.maximum(of - 1, 1)

    best = np.argmax(np.stack([left_out(one, total), left_out(two, after_one), left_out(three, after_two)]), axis=0)
    shares = np.bincount(best, weights=often, minlength=3) / max(often.sum(), 1)
    return tuple(float(x) for x in shares)


def train(documents: list[tuple[list[list[str]], int]], config: ReadingConfig, residual: bool = True) -> BandModels:
    """Models of the bands found among (sentences, band)."""
    return train_corpus(corpus_of_sentences([s for s, _ in documents]), np.array([b for _, b in documents]), config, residual)


def train_corpus(corpus: Corpus, own_bands: np.ndarray, config: ReadingConfig, residual: bool = True) -> BandModels:
    """Models of the bands of a corpus' documents, none of which is without words."""
    missed = np.zeros(len(corpus), dtype=bool)
    if residual and len(corpus) >= 2 * config.residual_documents:
        for half in (0, 1):
            held, rest = np.arange(half, len(corpus), 2), np.arange(1 - half, len(corpus), 2)
            model = train_corpus(corpus.take(rest), own_bands[rest], config, False)
            missed[held] = likeliest(model.own_numbers(corpus.take(held)), model) != own_bands[held]
    bands = sorted({int(b) for b in own_bands})
    often = np.bincount(corpus.texts.words, minlength=len(corpus.names))
    lower_often = np.bincount(corpus.lower, weights=often, minlength=len(corpus.lowers)).astype(np.int64)
    words = [(corpus.lowers[i], int(lower_often[i])) for i in np.flatnonzero(lower_often >= max(config.least_count, 1))]
    frequent = [w for w, _ in sorted(words, key=lambda x: (-x[1], x[0]))[: config.vocabulary]]
    model = BandModels(bands, known={"<other>": 0} | {w: i + 1 for i, w in enumerate(frequent)}, config=config)
    classes: Counter[str] = Counter()
    for size, n in zip(*np.unique(np.diff(corpus.texts.starts), return_counts=True), strict=True):
        classes[length_class(size)] += int(n)
    known = np.array([w in model.known for w in corpus.lowers], dtype=bool)[corpus.lower]
    for i in np.flatnonzero((often > 0) & ~known):
        classes[corpus.classes[i]] += int(often[i])
    for c, _ in sorted(classes.items(), key=lambda x: (-x[1], x[0]))[: config.vocabulary]:
        model.known.setdefault(c, len(model.known))
    size = len(model.known)
    texts = model.own_numbers(corpus)
    column = np.zeros(len(corpus), dtype=np.int64)
    for band in bands:
        members = np.flatnonzero(own_bands == band)
        odd = members[missed[members]]
        if config.residual_documents <= len(odd) < len(members):
            column[odd] = len(model.columns)
            model.columns.append(band)
            members = members[~missed[members]]
        kinds = _kinds(texts.take(members), model, max(1, min(config.components, len(members) // config.component_documents)))
        column[members] = len(model.columns) + kinds
        model.columns += [band] * (int(kinds.max()) + 1)
    width = len(model.columns)
    one, firsts = np.zeros(size * width, dtype=np.int64), np.zeros(size * width, dtype=np.int64)
    cells = Cells(), Cells(), Cells()  # of two words, of the two before a third, of three
    for i, part in enumerate(texts.parts(COUNTED_AT_ONCE)):
        flat, starts = model.with_lengths(part)
        before, further = _before(flat, starts)
        where_to = column[i * COUNTED_AT_ONCE + _owners(part, starts, len(flat))]
        one += np.bincount(flat * width + where_to, minlength=size * width)
        firsts += np.bincount(before * width + where_to, minlength=size * width)
        for own, keys in zip(cells, (before * size + flat, further * size + before, (further * size + before) * size + flat), strict=True):
            own.add(keys * width + where_to)
    one, firsts = one.reshape(size, width), firsts.reshape(size, width)
    (pair, pairs), (head, heads), (triple, triples) = (x.together() for x in cells)
    key, at = np.divmod(triple, width)
    rest, last = np.divmod(key, size)
    middle = rest % size
    after_two = heads[np.searchsorted(head, rest * width + at)]
    shares = fitted_weights(one[last, at], pairs[np.searchsorted(pair, (middle * size + last) * width + at)], triples, firsts[middle, at], after_two, one.sum(axis=0)[at], triples)
    model.weights = tuple(x * (1 - config.weight_uniform) for x in shares)
    model.keys, model.two = _table(pair, pairs, firsts[pair // width // size, pair % width], width, config.two_words, 1)
    model.long_keys, model.three = _table(triple, triples, after_two, width, config.three_words, 2)
    one = one + 0.1
    model.one = (model.weights[0] * one / one.sum(axis=0) + config.weight_uniform / size).astype(np.float32)
    model.two *= np.float32(model.weights[1])
    model.three *= np.float32(model.weights[2])
    return model


def _table(cells: np.ndarray, often: np.ndarray, context: np.ndarray, width: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent keys, sorted, and per component their counts over those of their contexts, before a row of zeros.

    ``cells`` are the distinct keys times ``width`` plus the component, sorted.
    """
    key, column = np.divmod(cells, width)
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    total = np.add.reduceat(often, begins)
    keep = total >= least
    if keep.sum() > most:
        keep = np.zeros(len(begins), dtype=bool)
        keep[np.argsort(-total, kind="stable")[:most]] = True
    sizes = np.diff(np.append(begins, len(key)))
    row, use = np.repeat(np.cumsum(keep) - 1, sizes), np.repeat(keep, sizes)
    out = np.zeros((int(keep.sum()) + 1, width), dtype=np.float32)
    out[row[use], column[use]] = often[use] / context[use]
    return key[begins][keep], out


class Cells:
    """Distinct numbers, sorted, and how often they are there."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, cells: np.ndarray) -> None:
        self.parts.append(np.unique(cells, return_counts=True))
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
            self._join()

    def _join(self) -> None:
        cells, often = (np.concatenate(x) for x in zip(*(self.parts.pop() for _ in range(2)), strict=True))
        order = np.argsort(cells, kind="stable")
        cells, often = cells[order], often[order]
        begins = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        self.parts.append((cells[begins], np.add.reduceat(often, begins)))

    def together(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.parts) > 1:
            self._join()
        return self.parts[0]


def _owners(texts: Texts, starts: np.ndarray, length: int) -> np.ndarray:
    """The document of each word that ``with_lengths`` gives."""
    return np.repeat(np.arange(len(texts)), np.diff(np.append(starts, length)[texts.docs]))


def _kinds(texts: Texts, model: BandModels, kinds: int, rounds: int = 8) -> np.ndarray:
    """A kind from 0 for each text, by means of their most frequent words."""
    if kinds <= 1:
        return np.zeros(len(texts), dtype=np.int64)
    size = len(model.known)
    common = np.argsort(-sum(np.bincount(model.with_lengths(part)[0], minlength=size) for part in texts.parts()), kind="stable")[:600]
    slot = np.full(size, -1)
    slot[common] = np.arange(len(common))
    rows = np.zeros((len(texts), len(common)))
    for i, part in enumerate(texts.parts()):
        flat, starts = model.with_lengths(part)
        at, row = slot[flat], _owners(part, starts, len(flat))
        rows[i * SCORED_AT_ONCE :][: len(part)] = np.bincount(row[at >= 0] * len(common) + at[at >= 0], minlength=len(part) * len(common)).reshape(len(part), -1)
    rows /= np.maximum(rows.sum(axis=1, keepdims=True), 1)
    np.sqrt(rows, out=rows)
    middles = [rows[0]]
    while len(middles) < kinds:  # the text farthest from those chosen
        middles.append(rows[np.argmin(np.max(rows @ np.array(middles).T, axis=1))])
    own = np.zeros(len(rows), dtype=np.int64)
    for _ in range(rounds):
        own = (rows @ np.array(middles).T).argmax(axis=1)
        middles = [m / max(np.sqrt(m @ m), 1e-9) for m in (rows[own == k].sum(axis=0) if (own == k).any() else middles[k] for k in range(kinds))]
    return np.unique(own, return_inverse=True)[1]


def likeliest(texts: Texts, model: BandModels) -> np.ndarray:
    """The band whose best component explains each whole text in the fewest bits."""
    found = []
    for part in texts.parts():
        bits = np.add.reduceat(model.surprisal(*model.with_lengths(part)), part.docs[:-1], axis=0)
        found.append(np.array(model.columns)[bits.argmin(axis=1)])
    return np.concatenate(found)


def difficulties(texts: Texts, model: BandModels) -> np.ndarray:
    """Per document: words, difficulty, share of its text in the highest band, bits per token.

    ``texts`` has the model's numbers. A document without words has zero words and NaN elsewhere.
    """
    out = np.full((len(texts), 4), np.nan)
    out[:, 0] = 0
    if not len(texts.words):
        return out
    bits = model.surprisal(*model.with_lengths(texts))
    columns = np.array(model.columns)
    bits = np.stack([bits[:, columns == b].min(axis=1) for b in model.bands], axis=1)
    least = bits.min(axis=1)
    share = np.exp2(model.config.evidence * (least[:, None] - bits))
    share /= share.sum(axis=1, keepdims=True)
    level = share @ np.array(model.bands, dtype=float)
    size = np.diff(texts.docs)
    some = np.flatnonzero(size)  # documents with words, and where their sentences begin
    first, owner = texts.docs[some], np.repeat(np.arange(len(some)), size[some])
    weights = np.diff(texts.starts).astype(float)
    total = np.add.reduceat(weights, first)
    order = np.lexsort((level, owner))
    upto = np.cumsum(weights[order])
    upto = (upto - (np.cumsum(total) - total)[owner]) / total[owner]
    middle = sum(level[order][first + np.add.reduceat((upto < q).astype(np.int64), first)] for q in (0.4, 0.5, 0.6)) / 3
    mean, hardest, all_bits = (np.add.reduceat(x, first) for x in (weights * level, weights * share[:, -1], least.astype(float)))
    out[some] = np.stack([total, 0.75 * middle + 0.25 * mean / total, hardest / total, all_bits / (total + size[some])], axis=1)
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = [(v, s / w) for s, w, first, last in pools for v in ((first, last) if first < last else (first,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


@dataclass
class ReadingModel:
    """``packed`` models, which the driver hands on as they are."""

    packed: bytes
    knots: tuple[np.ndarray, np.ndarray]

    @cached_property
    def models(self) -> BandModels:
        return pickle.loads(self.packed)

    def grade(self, difficulty: np.ndarray) -> np.ndarray:
        return np.interp(difficulty, *self.knots)


def fold_scores(corpus: Corpus, bands: np.ndarray, fold: int, config: ReadingConfig) -> tuple[np.ndarray, np.ndarray]:
    """The documents of a fold and their difficulties under models trained on the others."""
    own = np.arange(len(corpus)) % config.folds == fold
    held, rest = np.flatnonzero(own), np.flatnonzero(~own)
    if not len(held) or not len(rest):
        return held[:0], np.array([])
    return held, _scores(corpus.take(held), train_corpus(corpus.take(rest), _whole(bands[rest]), config))


def _whole(bands: np.ndarray) -> np.ndarray:
    """The nearest whole bands."""
    return np.trunc(bands + 0.5).astype(np.int64)


def _scores(corpus: Corpus | list[list[list[str]]], model: BandModels) -> np.ndarray:
    """``difficulties`` alone, some documents at a time."""
    corpus = corpus if isinstance(corpus, Corpus) else corpus_of_sentences(corpus)
    return np.concatenate([difficulties(part, model)[:, 1] for part in model.own_numbers(corpus).parts()])


def fit(sample: DataFrame, config: ReadingConfig) -> ReadingModel | None:
    """The model of labelled documents (order, item, text, band); None without a usable label.

    Every fold and the final model is a task that reads all of them; the driver sees scores and the model alone.
    """
    tasks = config.folds + 1

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["order", "item"], kind="stable")
        corpus, bands = corpus_of(part["text"].tolist()), part["band"].to_numpy(dtype=float)
        some = np.flatnonzero(np.diff(corpus.texts.docs))
        corpus, bands = corpus.take(some), bands[some]
        task = int(part["task"].iloc[0])
        if not len(corpus):
            return pd.DataFrame({"at": [], "score": [], "band": [], "model": []})
        if task < config.folds:
            held, scores = fold_scores(corpus, bands, task, config)
            return pd.DataFrame({"at": held, "score": scores, "band": bands[held], "model": [None] * len(held)})
        model = train_corpus(corpus, _whole(bands), config)
        own = _scores(corpus, model) if len(corpus) < 2 * config.folds else None
        rows = [(i, float(own[i]), bands[i], None) for i in range(len(corpus))] if own is not None else []
        return pd.DataFrame([*rows, (-1, 0.0, 0.0, pickle.dumps(model))], columns=["at", "score", "band", "model"])

    spread_ = sample.withColumn("task", F.explode(F.array(*[F.lit(i) for i in range(tasks)]))).repartitionByRange(tasks, "task")
    found = spread_.groupBy("task").applyInPandas(work, "at long, score double, band double, model binary").toPandas()
    models = found[found["model"].notna()]
    if not len(models):
        return None
    scored = found[(found["at"] >= 0) & found["score"].notna()].sort_values(["at"], kind="stable")
    return ReadingModel(bytes(models["model"].iloc[0]), isotonic(scored["score"].to_numpy(), scored["band"].to_numpy()))


def reading_levels(docs: DataFrame, item: str, text: str, labels: DataFrame, config: ReadingConfig | None = None) -> DataFrame:
    """(item, words, difficulty, grade, band, hardest_share, bits) of every document.

    ``labels`` has the item column, band and rater; a repeated judgement counts once, and several raters' bands are
    averaged. ``words`` counts stretches between white space; ``grade`` is the isotonic fit, ``band`` the nearest whole
    band; ``hardest_share`` the share of the text that the highest band's model explains; ``bits`` the surprisal per
    token under the best band. A null or empty text, or one without a word, has zero words and nulls. Equal texts get
    equal results; a repeated item gets a row each time. Without usable labels all results but the words are null.
    Whole texts are scored. Other columns are ignored, whatever their names. Empty tables give an empty result. All
    labelled documents, whole, are trained on; where ``labelled_rows`` or ``labelled_chars`` are given, so many in the
    order of a hash of their ids.
    """
    config = config or ReadingConfig()
    rows = docs.select(F.col(item).alias("item"), F.col(text).alias("text"))
    judged = labels.select(F.col(item).alias("item"), F.col("band").cast("double").alias("band"), "rater").dropna(subset=["item", "band"]).distinct()
    judged = judged.groupBy("item").agg(F.avg("band").alias("band"))
    if config.labelled_rows is not None:
        judged = judged.orderBy(F.xxhash64("item"), "item").limit(config.labelled_rows)
    if judged.count() <= BROADCAST_LABELS:
        judged = F.broadcast(judged)  # counted; else texts and labels meet by an exchange of both
    usable = rows.filter(F.length(F.trim("text")) > 0).join(judged, "item").dropDuplicates(["item"]).withColumn("order", F.xxhash64("item"))
    if config.labelled_chars is not None:
        upto = Window.orderBy("order", "item").rowsBetween(Window.unboundedPreceding, 0)
        usable = usable.withColumn("upto", F.sum(F.length("text")).over(upto)).filter(F.col("upto") <= config.labelled_chars)
    sample = usable.select("order", "item", "text", "band")
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, config))

    def score(batches):
        own = model.value
        numbers = Numbers(own.models.number) if own is not None else None
        for batch in batches:
            for i in range(0, batch.num_rows, SCORED_AT_ONCE):
                part = batch.slice(i, SCORED_AT_ONCE)
                texts = part.column("text").to_pylist()
                words = [len(t.split()) if t else 0 for t in texts]
                if own is None:
                    found = np.full((len(texts), 4), np.nan)
                else:
                    found = difficulties(numbered(texts, numbers), own.models)
                grade = own.grade(found[:, 1]) if own is not None else found[:, 1]
                empty = np.isnan(found[:, 1])
                band = pa.array(np.where(empty, 0, np.floor(grade + 0.5)).astype(np.int32), mask=empty)
                floats = [pa.array(np.round(v, 6), mask=empty) for v in (found[:, 1], grade, found[:, 2], found[:, 3])]
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(words, pa.int64()), floats[0], floats[1], band, floats[2], floats[3]], ["item", "words", "difficulty", "grade", "band", "hardest_share", "bits"])

    kind = rows.schema["item"].dataType.simpleString()
    out = spread(docs).select(F.col(item).alias("item"), F.col(text).alias("text")).mapInArrow(score, f"item {kind}, words long, difficulty double, grade double, band int, hardest_share double, bits double")
    return out.withColumnRenamed("item", item)
