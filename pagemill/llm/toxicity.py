"""Toxicity by a support vector machine on a gap-weighted subsequence kernel.

The string kernel counts the subsequences of ``ORDER`` characters that two strings
share, each weighted by ``DECAY`` to the power of the stretch it spans, so that an
insult with inserted, dropped or changed characters stays close to the plain one. It is
evaluated by its own features, exactly: a string's subsequences and their weights, with
no gate before it.

A sentence is scored by its worst window. Windows are its words as they stand, the
letters alone of a word with other characters inside, and runs of very short pieces
joined (``i d i o t``); longer words are cut in overlapping windows of ``LONGEST``.

Landmarks (Nystroem) are windows of both classes from the training sentences: such as
stand nearly only in toxic ones, the most frequent others, and then the clean ones that
come nearest to toxic. A window's kernel values with the landmarks, mapped by the inverse
root of the landmarks' own kernel matrix, are the features of a linear SVM. Toxic windows are
those that stand nearly only in toxic sentences, and the worst one of each, found anew each
round; all windows of a clean sentence are clean. Copies of toxic windows with a character inserted, dropped or changed are
trained on too. Margins are calibrated to probabilities.

The trained machine is one weight for each subsequence (1 MB): scoring is one narrow
``mapInArrow`` over the whole text of every document, and each worker remembers the
margins of windows it has seen (``CACHE`` at most, changing the speed only).

Training reads at most ``MAX_TRAIN`` labelled rows of at most ``MAX_TRAIN_BYTES`` bytes,
those with the smallest hash of doc_id (a documented bound on the sample).

Defined results: a null or empty text gets the score of a sentence without windows;
rows are scored each for itself; without usable labels of both classes every score is 0;
other columns, whatever their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import named, tidy

ORDER = 3
DECAY = 0.7
#: Characters told apart: the most frequent ones of the training rows; all others count as one.
ALPHABET = 64
LONGEST = 18
MAX_TRAIN, MAX_TRAIN_BYTES = 6_000, 32_768
LANDMARKS = 192  # of each kind: toxic, frequent, hard
SAMPLE, HARD = 3_000, 1_500
ROUNDS = 3
#: Different words before a window that stands for toxic ones from the start. Fewer will do, one at last, until
#: ``COVERED`` hundredths of the toxic texts have such a window: small sets of labels show each insult a few times only.
SUPPORT, COVERED = 6, 50
CACHE = 1_000_000
FOLDS, HELD_OUT = 5, 0
#: The margin of what has no window.
NONE = float("-inf")
#: Stand around each window and take part in its subsequences.
START, END = "\x02", "\x03"
INNER = re.compile(r"[\W\d_]+")


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def piece_windows(piece: str) -> tuple[str | None, list[str]]:
    """(its letter, or "", if a lower-case piece has one at most; else None), and the piece's windows."""
    letters = INNER.sub("", piece)
    if len(letters) <= 1:
        return letters, []
    return None, [x for w in dict.fromkeys((piece.strip(".,;:!?()[]\"'"), letters)) for x in _cut(w)]


def _cut(w: str) -> list[str]:
    if len(w) <= LONGEST:
        return [f"{START}{w}{END}"] if len(w) >= ORDER else []
    step = LONGEST // 2
    return [f"{START}{w[k : k + LONGEST]}{END}" for k in range(0, len(w) - LONGEST + step, step)]


def run_windows(pieces: list[str], letter: dict[str, str]) -> list[str]:
    """Windows of runs of pieces with one letter at most, three letters or more in all; ``letter`` has such pieces' letters."""
    out: list[str] = []
    run: list[str] = []
    for piece in [*pieces, None]:
        own = letter.get(piece) if piece is not None else None
        if own:
            run.append(own)
        elif own is None:
            if len(run) > 2:
                out += _cut("".join(run))
            run = []
    return out


def windows(text: str | None) -> set[str]:
    """The different windows of a text."""
    pieces = (text or "").lower().split()
    own = {p: piece_windows(p) for p in set(pieces)}
    letter = {p: x for p, (x, _) in own.items() if x is not None}
    return {w for _, ws in own.values() for w in ws}.union(run_windows(pieces, letter) if letter else ())


_COMBINED: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _combined(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (ORDER, k) of all subsequences of a string of n characters, and their weights."""
    if n not in _COMBINED:
        places = np.array(list(itertools.combinations(range(n), ORDER))).T
        _COMBINED[n] = places, (DECAY ** (places[-1] - places[0] + 1.0)).astype(np.float32)
    return _COMBINED[n]


class Alphabet:
    def __init__(self, letters: str) -> None:
        self.letters = letters
        self.table = np.zeros(0x110000 if any(ord(c) >= 0x3000 for c in letters) else 0x3000, np.int32)
        for k, c in enumerate(letters):
            self.table[ord(c)] = k + 1

    def features(self, strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(which strings, subsequence codes, weights, norms) for each length in turn, a bounded number at once."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        for n in np.unique(lengths):
            if n < ORDER:
                continue
            places, weights = _combined(int(n))
            same = np.flatnonzero(lengths == n)
            for at in range(0, len(same), max(1, 400_000 // len(weights))):
                own = same[at : at + max(1, 400_000 // len(weights))]
                points = np.frombuffer("".join(strings[k] for k in own).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(own), n)
                chars = np.where(points < len(self.table), self.table[np.minimum(points, len(self.table) - 1)], 0)
                codes = chars[:, places[0]]
                for p in places[1:]:
                    codes = codes * ALPHABET + chars[:, p]
                order = np.argsort(codes, axis=1, kind="stable")
                flat = np.take_along_axis(codes, order, 1) + (np.arange(len(own)) * ALPHABET**ORDER)[:, None]
                flat = flat.ravel()
                first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                sums = np.add.reduceat(weights[order].ravel().astype(np.float64), first)
                yield own, codes, weights, np.bincount(flat[first] // ALPHABET**ORDER, sums * sums) ** 0.5


def subsequence_kernel(a: str, b: str, alphabet: Alphabet) -> float:
    """Of two strings, normalised."""
    out = kernel_matrix([a], [b], alphabet)
    return float(out[0, 0])


def kernel_matrix(strings: list[str], landmarks: list[str], alphabet: Alphabet) -> np.ndarray:
    """Normalised kernel values (string, landmark)."""
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []
    for own, codes, weights, norms in alphabet.features(landmarks):
        rows += [(int(k), codes[i], weights / norms[i]) for i, k in enumerate(own)]
    known = np.unique(np.concatenate([c for _, c, _ in rows])) if rows else np.zeros(0, np.int64)
    table = np.zeros((len(known) + 1, len(landmarks)), np.float32)  # the last row for codes of no landmark
    for k, codes, values in rows:
        np.add.at(table, (np.searchsorted(known, codes), k), values)
    out = np.zeros((len(strings), len(landmarks)))
    for own, codes, weights, norms in alphabet.features(strings):
        for at in range(0, len(own), max(1, 40_000 // len(weights))):
            part = slice(at, at + max(1, 40_000 // len(weights)))
            place = np.minimum(np.searchsorted(known, codes[part]), max(len(known) - 1, 0))
            place = np.where(known[place] == codes[part], place, len(known)) if len(known) else np.zeros_like(codes[part])
            out[own[part]] = np.einsum("bcl,c->bl", table[place], weights) / norms[part, None]
    return out


@dataclass(eq=False)
class Model:
    """``weights`` has the landmarks' folded sum for each subsequence; empty if nothing was learned."""

    letters: str = ""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and (self.letters, self.bias, self.slope, self.shift) == (other.letters, other.bias, other.slope, other.shift) and np.array_equal(self.weights, other.weights)

    def margins(self, strings: list[str], alphabet: Alphabet) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        for own, codes, weights, norms in alphabet.features(strings):
            out[own] += (self.weights[codes] @ weights) / norms
        return out

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


class Scorer:
    """Scores of texts. Of each piece the worst window's margin is remembered, or the letter that it adds to a run."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.alphabet = Alphabet(model.letters)
        self.margin: dict[str, float] = {}
        self.letter: dict[str, str] = {}

    def _learn(self, pieces: set[str]) -> None:
        own = {p: piece_windows(p) for p in pieces}
        self.letter.update((p, x) for p, (x, _) in own.items() if x is not None)
        flat = [w for _, ws in own.values() for w in ws]
        at, margins = 0, self.model.margins(flat, self.alphabet).tolist()
        for p, (_, ws) in own.items():
            self.margin[p] = max(margins[at : at + len(ws)], default=NONE)
            at += len(ws)

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        if not len(self.model.weights):
            return [0.0 for _ in texts]
        split = [(t or "").lower().split() for t in texts]
        sets = [set(x) for x in split]
        fresh = set().union(*sets) - self.margin.keys()
        if len(self.margin) + len(fresh) > CACHE:
            self.margin.clear()
            self.letter.clear()
            fresh = set().union(*sets)
        self._learn(fresh)
        out, get, letter = [], self.margin.__getitem__, self.letter
        for pieces, own in zip(split, sets, strict=True):
            best = max(map(get, own), default=NONE)
            if sum(map(letter.__contains__, pieces)) > 2 and (runs := run_windows(pieces, letter)):
                best = max(best, float(self.model.margins(runs, self.alphabet).max()))
            out.append(self.model.probability(self.model.bias if best == NONE else best))
        return out


def altered(window: str) -> list[str]:
    """Copies with a character inserted, dropped, doubled or changed in the middle."""
    mid = len(window) // 2
    return [window[:mid] + "x" + window[mid:], window[:mid] + window[mid + 1 :], window[:mid] + "*" + window[mid + 1 :], window[:mid] + window[mid] + window[mid:]]


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps over the rows inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag(np.r_[np.full(x.shape[1], 1 / (2 * cost)), 1e-6])
    inside = np.ones(len(z), bool)
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        zs = z[inside] * weight[inside, None]
        fresh = np.linalg.solve(ridge + zs.T @ z[inside], zs.T @ y[inside])
        w = fresh if not w.any() else w + 0.7 * (fresh - w)
        now = y * (z @ w) < 1
        if (now == inside).all():
            w = fresh
            break
        inside = now
    return w[:-1], float(w[-1])


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton steps; the slope stays positive."""
    a, b = 1.0, 0.0
    z = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        grad = z.T @ (p - label) + np.array([1e-3 * a, 0])
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), grad)
        a, b = max(a - np.clip(step[0], -2, 2), 1e-3), b - float(np.clip(step[1], -2, 2))
    return float(a), float(b)


def _machine(landmarks: list[str], strings: list[str], y: np.ndarray, weight: np.ndarray, alphabet: Alphabet) -> Model:
    """The SVM on Nystroem features, folded into one weight for each subsequence."""
    values, vectors = np.linalg.eigh(kernel_matrix(landmarks, landmarks, alphabet))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    w, bias = _svm(kernel_matrix(strings, landmarks, alphabet) @ root, y, weight)
    folded = np.zeros(ALPHABET**ORDER)
    share = root @ w
    for own, codes, weights, norms in alphabet.features(landmarks):
        np.add.at(folded, codes, (share[own] / norms)[:, None] * weights)
    return Model(alphabet.letters, folded.astype(np.float32), bias)


def _pure(names: list[str], seen: dict[str, list[int]], spread: dict[str, int], bags: list[tuple[set[str], int]], n: list[int]) -> set[str]:
    """Windows that stand for toxic texts from the start; never none where a toxic text has windows."""
    toxic = [own for own, label in bags if label and own]
    pure: set[str] = set()
    for support in range(SUPPORT, 0, -1):
        pure = {w for w in names if spread[w] >= support and seen[w][1] * n[0] >= 20 * seen[w][0] * n[1]}
        if 100 * sum(not own.isdisjoint(pure) for own in toxic) >= COVERED * len(toxic):
            break
    # Where clean texts have all these windows too, each toxic text gives the one that is rarest in clean ones.
    return pure or {min(own, key=lambda w: (seen[w][0] / seen[w][1], w)) for own in toxic}


def fit(texts: list[tuple[str, int]]) -> Model:
    """Train on labelled texts, in whatever order they come."""
    texts = sorted(set(texts))
    bags = [(windows(t), label) for t, label in texts]
    if len({label for _, label in bags}) < 2 or not all(any(b for b, label in bags if label == k) for k in (0, 1)):
        return Model()
    seen: dict[str, list[int]] = {}
    letters: dict[str, int] = {}
    for own, label in bags:
        for w in own:
            seen.setdefault(w, [0, 0])[label] += 1
            for c in w:
                letters[c] = letters.get(c, 0) + 1
    alphabet = Alphabet(START + END + "".join(sorted(letters.keys() - {START, END}, key=lambda c: (-letters[c], c))[: ALPHABET - 3]))
    # Texts that a window stands in differ, but copies with small changes may be many: what stands before it must differ too.
    before: dict[str, set[str]] = {}
    for text, label in texts:
        if label:
            pieces = text.lower().split()
            for prior, piece in zip(["", *pieces], pieces, strict=False):
                before.setdefault(INNER.sub("", piece), set()).add(prior)
    n = [sum(label == k for _, label in bags) for k in (0, 1)]
    names = sorted(seen)
    spread = {w: min(seen[w][1], len(before.get(INNER.sub("", w), ()))) for w in names}
    # Twenty times as likely in a toxic text as in a clean one, whatever share is toxic.
    pure = _pure(names, seen, spread, bags, n)
    toxic = sorted(pure, key=lambda w: (-spread[w], w))[:LANDMARKS]
    clean = [w for w in names if seen[w][0]]
    frequent = sorted(clean, key=lambda w: (-seen[w][0], w))[:LANDMARKS]
    landmarks = sorted({*toxic, *frequent})
    negative = sorted(clean, key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))[:SAMPLE]
    worst = {}
    for k, (own, label) in enumerate(bags):
        if label and (found := own & pure):
            worst[k] = max(found, key=lambda w: (spread[w], w))
    known = set(clean)
    model = Model()
    for round_ in range(ROUNDS):
        counts = {w: spread[w] for w in pure}
        for w in worst.values():
            counts[w] = max(counts.get(w, 0), 1)
        if not counts or not negative:
            return Model()
        positive = sorted(counts)
        copies = sorted({x for w in positive for x in altered(w) if len(x) >= ORDER} - known - set(positive))
        strings = [*positive, *copies, *negative]
        y = np.r_[np.ones(len(positive) + len(copies)), -np.ones(len(negative))]
        weight = np.r_[[min(counts[w], 10.0) for w in positive], np.full(len(copies), 0.5), np.ones(len(negative))]
        model = _machine(landmarks, strings, y, weight, alphabet)
        margin = dict(zip(names, model.margins(names, alphabet).tolist(), strict=True))
        hard = sorted(clean, key=lambda w: (-margin[w], w))[:HARD]
        negative = sorted({*negative[:SAMPLE], *hard} - pure)
        if round_ == 0:
            landmarks = sorted({*landmarks, *(w for w in hard if w not in pure and seen[w][0] * n[1] > seen[w][1] * n[0])} if len(hard) <= LANDMARKS else {*landmarks, *hard[:LANDMARKS]})
        worst = {k: max(own, key=lambda w: (margin[w], w)) for k, (own, label) in enumerate(bags) if label and own}
        worst = {k: w for k, w in worst.items() if margin[w] > 0 or w in pure}
    margin = dict(zip(names, model.margins(names, alphabet).tolist(), strict=True))
    best = np.array([max((margin[w] for w in own), default=model.bias) for own, _ in bags])
    model.slope, model.shift = _calibrate(best, np.array([float(label) for _, label in bags]))
    return model


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most ``MAX_TRAIN`` labelled texts outside the held-out fold."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    chosen = usable.select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(MAX_TRAIN)
    # At most MAX_TRAIN rows of two numbers: the broadcast is bounded. Rows that share an id are bounded by the last limit.
    some = docs.where(F.octet_length("text") <= MAX_TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("text", "toxic").limit(MAX_TRAIN)
    return [(r.text, int(r.toxic)) for r in some.collect()]


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    slim = docs.select(named(id_col).alias("doc_id"), named(text).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(slim, labels)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            ids = b.column("doc_id").to_pylist()
            scores = scorer.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(map(held_out, ids), pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return slim.mapInArrow(tidy(rows), "doc_id bigint, held_out boolean, score double, predicted int")
