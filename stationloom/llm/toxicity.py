"""Toxicity by misspelled lexicon terms in their context.

A lexicon of words and word stems is learnt from labelled documents and kept as a trie. The Levenshtein
automaton of each term (no, one or two edits, by its length) is run against the trie, and the reachable sets
of (node, edits) become the states of one table, so a whole batch of words is matched by one table look-up
per letter, whatever the size of the lexicon. Every hit weighs what documents with such a hit, at that number
of edits, told about the label. Its context decides how much of that counts: a term inside quotation marks or
next to a word of reporting is mentioned, one next to "you" is aimed at somebody. Sums over windows of words,
over the document and per word make the probability.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationloom.llm.samples import Sample, labelled_sample
from stationloom.llm.text import span_hashes, text_slices, whole_text, word_spans

#: The training sample: documents of each label, and bytes in all, at most.
SAMPLE, SAMPLE_BYTES = {0: 2000, 1: 1000}, 8 << 20
#: The lexicon: terms at most, documents that must hold a term, and how much likelier they must be toxic.
MOST_TERMS, LEAST_DOCS, LEAST_LIFT, MOST_WEIGHT, COMMON = 120, 3, 8.0, 6.0, 0.015
#: Lengths of stems, and letters from which on a word may have one or two edits.
STEMS, ONE_EDIT, TWO_EDITS = range(3, 9), 5, 9
#: What is left of a term's weight per edit, before documents with such a hit say otherwise.
PER_EDIT = 0.6
#: Words around a hit: for the sum of a window, and in which a word of reporting or address acts.
WINDOW, NEAR = 25, 4
QUOTED, REPORTED, ADDRESSED = 0.2, 0.5, 1.3
THRESHOLD = 0.3

# Words of reporting, of address, and digits that stand for letters.
REPORTING = ("said says called calls calling word words term quote quoted quotes wrote insult insults slur slurs phrase "
             "sagte nannte wort begriff zitat mot terme citation traita dijo palabra insulto cita").split()
ADDRESS = "you your youre u yourself du dich dir ihr euch tu toi vous tú ti usted ustedes".split()
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
OPENING, CLOSING, STRAIGHT = "“„«‹", "”“»›", '"'


@lru_cache
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its folded letter, 0 where it belongs to no word; and whether it is a letter."""
    points = [chr(k) for k in range(0x110000)]
    folded = np.array([ord(DIGITS.get(c, c.lower() if len(c.lower()) == 1 else c)) if c.isalnum() else 0 for c in points], np.uint32)
    return folded, np.array([c.isalpha() for c in points])


@dataclass
class Words:
    """The words of some texts: folded letters, where each word and each text begins and ends."""

    points: np.ndarray
    letters: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Words:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), out=offsets[1:])
        points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
        folded, letter = _folding()
        letters = folded[points]
        starts, ends, _ = word_spans((letters > 0).view(np.uint8), offsets, np.arange(256) > 0)
        # a word has a letter, so numbers are none
        count = np.zeros(len(points) + 1, np.int32)
        np.cumsum(letter[points], out=count[1:], dtype=np.int32)
        some = count[ends] > count[starts]
        starts, ends = starts[some], ends[some]
        return cls(points, letters, offsets, starts, ends, np.searchsorted(starts, offsets))

    def text_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.before, words, side="right") - 1

    def string(self, start: int, end: int) -> str:
        return "".join(map(chr, self.letters[start:end]))


def _hash(word: str) -> int:
    values = np.array([ord(c) for c in word], np.uint32)
    return int(span_hashes(values, np.array([0]), np.array([len(values)]))[0])


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool

    @property
    def edits(self) -> int:
        return 0 if self.stem else (len(self.text) >= ONE_EDIT) + (len(self.text) >= TWO_EDITS)


class Automaton:
    """Levenshtein automata of all terms on their common trie, as one deterministic table.

    A state is the set of trie nodes that the letters so far lead to, each with its fewest edits, and the longest
    stem that has been passed. ``accept`` gives, per state at a word's end, ``3 * term + edits``, or -1. A word that is
    a term beats a stem of it, and a stem beats a term with edits; of terms the one with fewer edits, then the
    longer one wins.
    """

    def __init__(self, terms: list[Term]):
        self.terms = terms
        letters = sorted({c for t in terms for c in t.text})
        if len(letters) > 250:
            raise ValueError(f"The terms have {len(letters)} different letters, 250 at most")
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        self.children: list[dict[int, int]] = [{}]
        self.reach, self.word, self.stem = [0], [-1], [-1]
        for k, t in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], t.edits)
            for c in t.text:
                c = letters.index(c) + 2
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.reach.append(0), self.word.append(-1), self.stem.append(-1)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], t.edits)
            (self.stem if t.stem else self.word)[node] = k
        self._build(len(letters) + 2)

    def _closed(self, items: dict[int, int]) -> dict[int, int]:
        """With letters of the term left out."""
        todo = list(items)
        while todo:
            node = todo.pop()
            for child in self.children[node].values():
                e = items[node] + 1
                if e <= self.reach[child] and e < items.get(child, 9):
                    items[child] = e
                    todo.append(child)
        return items

    def _next(self, items: tuple, c: int) -> dict[int, int]:
        out: dict[int, int] = {}
        for node, e in items:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.reach[child] and cost < out.get(child, 9):
                    out[child] = cost
            if e < self.reach[node] and e + 1 < out.get(node, 9):
                out[node] = e + 1
        return self._closed(out)

    def _passed(self, items: dict[int, int], stem: int) -> int:
        for node, e in items.items():
            k = self.stem[node]
            if e == 0 and k >= 0 and (stem < 0 or len(self.terms[k].text) > len(self.terms[stem].text)):
                stem = k
        return stem

    def _accepted(self, items: tuple, stem: int) -> int:
        best = min(((e, -len(self.terms[self.word[n]].text), self.word[n]) for n, e in items if self.word[n] >= 0 and e <= self.terms[self.word[n]].edits), default=None)
        if best and (best[0] == 0 or stem < 0):
            return 3 * best[2] + best[0]
        return 3 * stem if stem >= 0 else -1

    def _build(self, classes: int) -> None:
        start = (tuple(sorted(self._closed({0: 0}).items())), -1)
        known, todo, table, accept = {start: 0}, [start], [], []
        while len(table) < len(todo):
            items, stem = todo[len(table)]
            row = np.zeros(classes, np.int32)
            cache: dict[int, int] = {}
            # letters that no node can take all lead to the same state
            useful = {c for node, _ in items for c in self.children[node]}
            for c in range(1, classes):
                c_key = c if c in useful else 1
                if c_key not in cache:
                    found = self._next(items, c_key)
                    state = (tuple(sorted(found.items())), self._passed(found, stem))
                    if state not in known:
                        known[state] = len(todo)
                        todo.append(state)
                    cache[c_key] = known[state]
                row[c] = cache[c_key]
            table.append(row)
            accept.append(self._accepted(items, stem))
        self.table, self.accept = np.array(table, np.int32), np.array(accept, np.int32)
        self.final = (self.table[:, 1:] == np.arange(len(table))[:, None]).all(axis=1)

    def classes(self, letters: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.letters, letters), max(0, len(self.letters) - 1))
        return np.where(self.letters[at] == letters, at + 2, 1).astype(np.uint8)

    def match(self, words: Words) -> np.ndarray:
        """``3 * term + edits`` of every word, or -1."""
        state = np.zeros(len(words.starts), np.int32)
        if not self.terms:
            return np.full(len(state), -1, np.int32)
        classes = self.classes(words.letters)
        going, at, left = np.arange(len(state)), words.starts.copy(), words.ends - words.starts
        while len(going):
            state[going] = self.table[state[going], classes[at]]
            left = left - 1
            more = (left > 0) & ~self.final[state[going]]
            going, at, left = going[more], at[more] + 1, left[more]
        return self.accept[state]


def _quoted(words: Words, hits: np.ndarray) -> np.ndarray:
    """Whether words stand inside quotation marks: straight ones by their parity in the line, others by kind."""
    if not len(hits):
        return np.empty(0, bool)
    at, text = words.starts[hits], words.text_of(hits)
    begin, end = words.offsets[text], words.offsets[text + 1]

    def last(positions):
        k = np.searchsorted(positions, at) - 1
        return np.where((k >= 0) & (positions[np.maximum(k, 0)] >= begin), positions[np.maximum(k, 0)], -1) if len(positions) else np.full(len(at), -1)

    def following(positions):
        k = np.searchsorted(positions, at)
        far = np.minimum(k, max(0, len(positions) - 1))
        return np.where((k < len(positions)) & (positions[far] < end), positions[far], -1) if len(positions) else np.full(len(at), -1)

    def where(chars):
        return np.flatnonzero(np.isin(words.points, [ord(c) for c in chars]))

    lines, straight = where("\n"), where(STRAIGHT)
    line = np.maximum(last(lines) + 1, begin)
    odd = (np.searchsorted(straight, at) - np.searchsorted(straight, line)) % 2 == 1
    stop, closing = following(lines), following(straight)
    inside = odd & (closing >= 0) & ((stop < 0) | (closing < stop))
    marks = where(OPENING + CLOSING)
    before, after = last(marks), following(marks)
    opened = (before >= 0) & np.isin(words.points[np.maximum(before, 0)], [ord(c) for c in OPENING])
    closed = (after >= 0) & np.isin(words.points[np.maximum(after, 0)], [ord(c) for c in CLOSING])
    return inside | (opened & closed)


@lru_cache
def _cues() -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([_hash(w) for w in cues], np.uint64) for cues in (REPORTING, ADDRESS))


def context_factors(words: Words, hits: np.ndarray) -> np.ndarray:
    """How much of a term's weight counts at each hit."""
    if not len(hits):
        return np.empty(0)
    text = words.text_of(hits)
    near = hits[:, None] + np.concatenate([np.arange(-NEAR, 0), np.arange(1, NEAR + 1)])
    own = (near >= words.before[text][:, None]) & (near < words.before[text + 1][:, None])
    at, back = np.unique(np.where(own, near, hits[:, None]), return_inverse=True)
    hashes = span_hashes_at(words, at)[back.reshape(near.shape)]
    reporting, address = _cues()
    reported = (np.isin(hashes, reporting) & own).any(axis=1)
    addressed = (np.isin(hashes, address) & own).any(axis=1)
    quoted = _quoted(words, hits)
    return np.where(quoted, QUOTED, 1.0) * np.where(reported & ~addressed, REPORTED, 1.0) * np.where(addressed & ~quoted, ADDRESSED, 1.0)


def span_hashes_at(words: Words, at: np.ndarray) -> np.ndarray:
    return _keys(words, words.starts[at], words.ends[at])


FEATURES = 4


def features(words: Words, hits: np.ndarray, weight: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Per text: the sum of what its hits count, the largest sum of a window, the sum per 100 words, and its different terms."""
    n = len(words.offsets) - 1
    out = np.zeros((n, FEATURES))
    if not len(hits):
        return out
    text = words.text_of(hits)
    total = np.bincount(text, weight, n)
    sums = np.append(0, np.cumsum(weight))
    first = np.searchsorted(text, text)
    until = np.minimum(np.searchsorted(hits, hits + WINDOW), np.searchsorted(text, text, side="right"))
    window = np.zeros(n)
    np.maximum.at(window, text, sums[until] - sums[np.maximum(np.arange(len(hits)), first)])
    count = np.maximum(np.diff(words.before), 1)
    pairs = np.unique(np.stack([text, slot // 3], axis=1)[weight > 0.5], axis=0)
    out[:, 0], out[:, 1] = np.log1p(total), np.log1p(window)
    out[:, 2], out[:, 3] = np.log1p(100 * total / count), np.log1p(np.bincount(pairs[:, 0], minlength=n))
    return out


@dataclass
class Model:
    """The automaton, the weight of each of its hits, and how features make a probability."""

    automaton: Automaton
    weights: np.ndarray
    slope: np.ndarray
    shift: float

    def features(self, words: Words) -> np.ndarray:
        slot = self.automaton.match(words)
        hits = np.flatnonzero(slot >= 0)
        slot = slot[hits]
        weight = self.weights[slot]
        some = weight > 0
        hits, slot = hits[some], slot[some]
        return features(words, hits, weight[some] * context_factors(words, hits), slot)

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.features(Words.of(texts)) @ self.slope + self.shift
        # rounded, so that what stands beside a text in a batch doesn't show
        return np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 9)


def _keys(words: Words, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span, some words at a time to save memory."""
    out = np.empty(len(starts), np.uint64)
    for k in range(0, len(starts), 50_000):
        a, b = starts[k : k + 50_000], ends[k : k + 50_000]
        out[k : k + 50_000] = span_hashes(words.letters[a[0] : b.max()], a - a[0], b - a[0])
    return out


def _candidates(words: Words, labels: np.ndarray) -> list[tuple[Term, float, np.ndarray]]:
    """Words and stems, their log odds and the toxic documents that hold them."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    text = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(words.before))
    length = words.ends - words.starts
    found = []
    for size in (0, *STEMS):
        own = np.flatnonzero(length > size if size else (length >= 3) & (length <= 40))
        if not len(own):
            continue
        starts, docs = words.starts[own], text[own]
        ends = starts + size if size else words.ends[own]
        keys = _keys(words, starts, ends)
        order = np.lexsort((docs, keys)).astype(np.int32)
        keys, docs = keys[order], docs[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))
        keys, docs, order = keys[fresh], docs[fresh], order[fresh]
        group = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        until = np.append(group[1:], len(keys))
        toxic = np.add.reduceat(labels[docs], group)
        other = until - group - toxic
        weight = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
        for k in np.flatnonzero((toxic >= min(LEAST_DOCS, n1)) & (weight >= np.log(LEAST_LIFT))):
            held = docs[group[k] : until[k]]
            w = order[group[k]]
            found.append((Term(words.string(starts[w], ends[w]), size > 0), min(float(weight[k]), MOST_WEIGHT), held[labels[held] == 1]))
    return found


def learn_terms(words: Words, labels: np.ndarray, most: int = MOST_TERMS) -> list[Term]:
    """Words and stems that toxic documents hold and others don't, the most telling first, none inside another.

    A document counts for further terms until the weights of those that it holds add up to ``MOST_WEIGHT`` (twice that for
    a term that the share ``COMMON`` of such documents hold), so what merely stands beside a term, as in copies of one
    document, isn't taken for one. Of a stem and its word, or stems
    of one another, in the same documents the longest is taken, and the whole word before the stem.
    """
    if not (labels == 1).any() or not (labels == 0).any():
        return []
    explained, n_toxic = np.zeros(len(labels)), int((labels == 1).sum())
    heap = []
    for term, weight, held in _candidates(words, labels):
        heap.append((-round(len(held) * weight**2, 6), term.stem, -len(term.text), term.text, weight, held))
    heapq.heapify(heap)
    terms: list[Term] = []
    letters: set[str] = set()
    while heap and len(terms) < most:
        value, stem, size, string, weight, held = heapq.heappop(heap)
        open_docs, half_open = int((explained[held] < MOST_WEIGHT).sum()), int((explained[held] < 2 * MOST_WEIGHT).sum())
        if half_open >= max(LEAST_DOCS, COMMON * n_toxic):
            open_docs = half_open
        now = -round(open_docs * weight**2, 6)
        if open_docs < min(LEAST_DOCS, len(held)) or now > value:
            if open_docs >= LEAST_DOCS:
                heapq.heappush(heap, (now, stem, size, string, weight, held))
            continue
        inside = any(t.stem and string.startswith(t.text) for t in terms)
        around = stem and any(t.text.startswith(string) for t in terms)
        if not inside and not around and len(letters | set(string)) <= 250:
            letters |= set(string)
            terms.append(Term(string, stem))
            explained[held] += weight
    return terms


def learn_weights(automaton: Automaton, words: Words, labels: np.ndarray) -> np.ndarray:
    """Log odds per term and number of edits, from the documents that hold it; edits start from a share of the term's own."""
    n1, n0, terms = int((labels == 1).sum()), int((labels == 0).sum()), len(automaton.terms)
    slot = automaton.match(words)
    hits = np.flatnonzero(slot >= 0)
    n = len(labels)
    pairs = np.unique(slot[hits].astype(np.int64) * n + words.text_of(hits))
    pairs = np.stack([pairs // n, pairs % n], axis=1)
    toxic = np.bincount(pairs[:, 0], labels[pairs[:, 1]], 3 * terms).reshape(terms, 3)
    other = np.bincount(pairs[:, 0], minlength=3 * terms).reshape(terms, 3) - toxic
    weights = np.zeros((terms, 3))
    weights[:, 0] = np.log((toxic[:, 0] + 0.5) / (n1 + 1)) - np.log((other[:, 0] + 0.5) / (n0 + 1))
    for e in (1, 2):
        prior = np.exp(PER_EDIT**e * weights[:, 0])  # odds among as many toxic as other documents
        a, b = toxic[:, e] / n1 + 2 * prior / (1 + prior) / (n1 + n0), other[:, e] / n0 + 2 / (1 + prior) / (n1 + n0)
        weights[:, e] = np.log(a / b)
    return np.clip(weights, 0, MOST_WEIGHT).ravel()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes and intercept by Newton's method, both labels weighing the same."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, own = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    penalty = ridge * np.append(np.ones(x.shape[1] - 1), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (own * (p - y)) + penalty * w
        hessian = (x * (own * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(sample: Sample) -> Model:
    """Terms and weights from all of the sample; how they make a probability from documents whose terms were learnt without them."""
    first = {t: k for k, t in reversed(list(enumerate(sample.texts)))}  # copies tell nothing new
    kept = sorted(first.values())
    texts, labels = [sample.texts[k] for k in kept], sample.labels[kept]
    if not len(labels) or labels.min() == labels.max():
        return Model(Automaton([]), np.empty(0), np.zeros(FEATURES), sample.log_odds)

    def learnt(part: np.ndarray) -> tuple[Automaton, np.ndarray]:
        words = Words.of(pa.array([texts[k] for k in part], pa.large_string()))
        automaton = Automaton(learn_terms(words, labels[part]))
        return automaton, learn_weights(automaton, words, labels[part])

    fold = np.arange(len(labels)) % 2
    apart = np.zeros((len(labels), FEATURES))
    for k in (0, 1):
        if np.unique(labels[fold != k]).size < 2:
            continue
        model = Model(*learnt(np.flatnonzero(fold != k)), np.zeros(FEATURES), 0.0)
        own = np.flatnonzero(fold == k)
        apart[own] = model.features(Words.of(pa.array([texts[j] for j in own], pa.large_string())))
    slope, shift = _logistic(apart, labels.astype(float))
    return Model(*learnt(np.arange(len(labels))), slope, shift + sample.log_odds)


def is_held_out(doc_id: Column) -> Column:
    """Whether a row is never learnt from: crc32 of the id as text leaves 2 by 4. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most: dict[int, int] | None = None, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from a bounded sample (``samples.labelled_sample``) of the labelled documents that aren't held out."""
    return train(labelled_sample(docs, labels, "toxic", is_held_out(F.col("doc_id")), most or SAMPLE, sample_bytes))


def toxicity_scores(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null texts count as empty; a text without hits has the score of a document in which nothing was found. Repeated
    rows each give a row, an empty table none. Texts are read whole, in slices of bounded size; other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out"), whole_text().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    # the table has at most MOST_TERMS terms in it
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                score = shared.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
