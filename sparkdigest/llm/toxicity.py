"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdigest.llm.common import pick, small, tidy

#: Letters of a subsequence, and how far apart its first and last letter may lie.
ORDER, SPAN = 3, 5
#: What each letter skipped inside a subsequence costs.
DECAY = 0.5
#: Letters of a string that the kernel takes at once; longer strings count as overlapping ones of this length.
WIDTH = 24
#: Training takes at most so many documents of each class, none longer than LONGEST characters.
SAMPLE, LONGEST = 1000, 20_000
#: Landmarks of the Nystrom map.
LANDMARKS = 96
#: Rounds in which the sentences that carry a toxic document's label are chosen anew.
ROUNDS = 4
#: Toxic strings that are learnt with letters put in, too, and the letters.
VARIED, LETTERS = 300, "xaetnqrz"
#: Strings of which a worker keeps the score.
KEPT = 400_000

#: Strings within a sentence: runs of other than white space.
_SINGLE = re.compile(r"(?:(?<=\s)|^)\S(?:\s+\S){2,}(?=\s|$)")
_OFFSETS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+|\n")


def _code(c: str) -> int:
    """6-bit code of a letter, 0 for what counts as an inserted character."""
    return ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 37 if c.isalpha() else 0


_CODES: dict[str, int] = {}


def strings(text: str | None) -> set[str]:
    """The strings of a text that are scored: its words, and words spelt with white space between their letters."""
    low = (text or "").lower()
    words = low.split()
    found = set(words)
    if sum(len(w) == 1 for w in found) > 2:
        found.update("".join(m[0].split()) for m in _SINGLE.finditer(low))
    return found


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters (rows of WIDTH + SPAN, 0 behind the end) and the word of each row."""
    rows, of = [], []
    for k, w in enumerate(words):
        for c in w:
            if c not in _CODES:
                _CODES[c] = _code(c)
        codes = [x for x in map(_CODES.__getitem__, w) if x]
        for at in range(0, max(1, len(codes) - SPAN), WIDTH - SPAN):
            rows.append(bytes(codes[at : at + WIDTH]).ljust(WIDTH + SPAN, b"\0"))
            of.append(k)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WIDTH + SPAN).astype(np.int32), np.array(of, np.int64)


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's subsequences (0: none) and their weights: DECAY to the power of the letters skipped."""
    feats, weights = [], []
    a = codes[:, :WIDTH]
    for i, j in _OFFSETS:
        b, c = codes[:, i : WIDTH + i], codes[:, j : WIDTH + j]
        feats.append(np.where((a > 0) & (b > 0) & (c > 0), (a << 12) | (b << 6) | c, 0))
        weights.append(np.full(WIDTH, DECAY ** (j - 2), np.float32))
    return np.concatenate(feats, axis=1), np.concatenate(weights)


def _norms(feats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Square root of the kernel of each row with itself: repeated subsequences add up before they are squared."""
    order = np.argsort(feats, axis=1)
    f, w = np.take_along_axis(feats, order, 1), weights[order] * (np.take_along_axis(feats, order, 1) > 0)
    new = np.ones(f.shape, bool)
    new[:, 1:] = f[:, 1:] != f[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel())) if f.size else np.empty(0)
    row = np.repeat(np.arange(len(f)), new.sum(axis=1))
    return np.sqrt(np.maximum(np.bincount(row, sums.astype(np.float64) ** 2, len(f)), 1e-12)).astype(np.float32)


def kernel_map(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subsequences, weights over the norm, and the word of each row."""
    codes, of = _letters(words)
    feats, weights = _features(codes)
    norms = _norms(feats, weights)
    return feats, weights, norms, of


@dataclass(frozen=True)
class Model:
    """beta: the SVM's weight of every subsequence, which is what its landmarks' weights add up to; calibration."""

    beta: np.ndarray
    bias: float
    slope: float
    shift: float

    def decisions(self, words: list[str]) -> np.ndarray:
        """The SVM's decision on each string; strings without a subsequence get the bias."""
        if not words:
            return np.empty(0)
        feats, weights, norms, of = kernel_map(words)
        rows = (self.beta[feats] @ weights) / norms + self.bias
        out = np.full(len(words), -np.inf)
        np.maximum.at(out, of, rows)
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.shift, -50, 50)))


def _svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 40) -> tuple[np.ndarray, float]:
    """Linear SVM on some rows of x with squared hinge loss, by Newton steps on the active set, in pieces of 8192 rows; the
    last weight is the bias."""
    m = x.shape[1] + 1
    w = np.zeros(m)
    eye = np.eye(m) * ridge
    eye[-1, -1] = 1e-9
    for _ in range(steps):
        a, b = eye.copy(), np.zeros(m)
        for at in range(0, len(rows), 8192):
            part = slice(at, at + 8192)
            z = np.ones((len(rows[part]), m))
            z[:, :-1] = x[rows[part]]
            act = y[part] * (z @ w) < 1
            za = z[act] * weight[part][act, None]
            a += za.T @ z[act]
            b += za.T @ y[part][act]
        new = np.linalg.solve(a, b)
        if np.allclose(new, w, rtol=1e-4, atol=1e-5):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(texts: list[str], toxic: list[int]) -> Model:
    """A model from labelled documents; without both classes it gives every string a score near 0.

    Sentences take their document's label. Those of clean documents are all clean; which sentences of a toxic document
    are toxic isn't said, so the machine chooses: it learns from all, keeps for each toxic document the sentences it
    finds most toxic, and learns again (multiple-instance learning). A sentence's features are those of its strings; the
    most toxic string decides. Landmarks are strings of toxic documents that clean ones don't have, by the number of
    documents, and frequent clean ones.
    """
    y = np.array(toxic, int)
    if not (y == 1).any() or not (y == 0).any():
        return Model(np.zeros(1 << 18, np.float32), 0.0, 0.0, -9.0)
    sentences = [[s for s in map(strings, _SENTENCE.split(t)) if s] for t in texts]
    whole = [strings(t).union(*s) for t, s in zip(texts, sentences, strict=True)]
    in_toxic: dict[str, int] = {}
    in_clean: dict[str, int] = {}
    for words, label in zip(whole, y, strict=True):
        count = in_toxic if label else in_clean
        for w in words:
            count[w] = count.get(w, 0) + 1
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    contrast = lambda w: in_toxic.get(w, 0) / n1 - 4 * in_clean.get(w, 0) / n0
    marks = sorted(in_toxic, key=lambda w: (-contrast(w), w))[: LANDMARKS // 2]
    marks += sorted((w for w in in_clean if w not in set(marks)), key=lambda w: (-in_clean[w], w))[: LANDMARKS - len(marks)]

    words = sorted(set().union(*whole))
    place = {w: k for k, w in enumerate(words)}
    # only subsequences of landmarks count, so the map has a column for each of these
    feats, weights, norms, of = kernel_map(marks)
    used = np.unique(feats[feats > 0])
    column = np.zeros(1 << 18, np.int32)
    column[used] = np.arange(1, len(used) + 1)
    phi_marks = np.zeros((len(marks), len(used) + 1), np.float32)
    for f, norm, k in zip(feats, norms, of, strict=True):
        np.add.at(phi_marks[k], column[f[f > 0]], weights[f > 0] / norm)
    values, vectors = np.linalg.eigh((phi_marks @ phi_marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    white = vectors[:, keep] / np.sqrt(values[keep])
    dense = (white.T @ phi_marks).astype(np.float32).T.copy()

    def mapping(some: list[str]) -> np.ndarray:
        out = np.zeros((len(some), dense.shape[1]), np.float32)
        for at in range(0, len(some), 2048):
            feats, weights, norms, of = kernel_map(some[at : at + 2048])
            np.add.at(out, at + of, _project(dense, column[feats], weights) / norms[:, None])
        return out

    mapped = mapping(words)
    clean = np.array(sorted(place[w] for w in in_clean), np.int64)
    of_clean = np.array([in_clean[words[k]] for k in clean], float)
    bags = [[np.array(sorted(place[w] for w in s), np.int64) for s in sentences[d]] for d in np.flatnonzero(y == 1)]
    # at first a toxic document's strings all count, by how much more often toxic documents have them
    first = np.array(sorted(place[w] for w in in_toxic if contrast(w) > 0), np.int64)
    gain = np.array([contrast(words[k]) for k in first]) ** 2
    if not len(first):
        return Model(np.zeros(1 << 18, np.float32), 0.0, 0.0, -9.0)
    chosen, amount = first, gain
    for _ in range(ROUNDS):
        t = np.concatenate([np.ones(len(chosen)), -np.ones(len(clean))])
        share = np.concatenate([amount / amount.sum(), np.sqrt(of_clean) / np.sqrt(of_clean).sum() * 3])
        w, bias = _svm(mapped, np.concatenate([chosen, clean]), t, share)
        score = mapped @ w.astype(np.float32) + bias
        witness: dict[int, float] = {}
        for bag in bags:
            best = [s[np.argmax(score[s])] for s in bag]
            top = max(score[k] for k in best) if best else 0
            for k in best:  # sentences near the document's most toxic one are toxic too
                if score[k] >= top - 0.3 and words[k] not in in_clean:
                    witness[k] = witness.get(k, 0) + 1
        if not witness:
            break
        chosen = np.array(sorted(witness), np.int64)
        amount = np.array([witness[k] for k in chosen], float)
    if witness:  # last, the same strings with a letter put in at each inner place
        base = sorted(witness, key=lambda k: (-witness[k], k))[:VARIED]
        varied = [(words[k][:i] + LETTERS[(k + i) % len(LETTERS)] + words[k][i:], witness[k]) for k in base for i in range(1, len(words[k].rstrip(".,!?;:")))]
        varied = [v for v in varied if v[0] not in in_clean]
        more = mapping([v[0] for v in varied])
        both = np.vstack([mapped, more])
        t = np.concatenate([np.ones(len(chosen) + len(more)), -np.ones(len(clean))])
        extra = np.array([v[1] for v in varied], float)
        share = np.concatenate([amount / amount.sum(), extra / max(extra.sum(), 1) / 2, np.sqrt(of_clean) / np.sqrt(of_clean).sum() * 3])
        w, bias = _svm(both, np.concatenate([chosen, len(words) + np.arange(len(more)), clean]), t, share)
        score = mapped @ w.astype(np.float32) + bias
    beta = np.zeros(1 << 18, np.float32)
    beta[used] = dense[1:] @ w.astype(np.float32)
    model = Model(beta, bias, 1.0, 0.0)
    top = np.array([max([model.bias, *score[[place[s] for s in ws]]]) if ws else model.bias for ws in whole])
    return _calibrated(model, top, y)


def _project(dense: np.ndarray, feats: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(feats), dense.shape[1]), np.float32)
    for f in range(feats.shape[1]):
        some = np.flatnonzero(feats[:, f])
        if len(some):
            out[some] += dense[feats[some, f]] * weights[f]
    return out


def _calibrated(model: Model, top: np.ndarray, y: np.ndarray) -> Model:
    """Cut at the decision that divides the training documents best, scaled so that a margin of 0.25 is plain."""
    order = np.argsort(top)
    s, t = top[order], y[order]
    # documents above a cut are called toxic: errors if the cut lies just before each place
    errors = np.concatenate([[0], np.cumsum(t == 1)]) + np.concatenate([np.cumsum((t == 0)[::-1])[::-1], [0]])
    edge = np.concatenate([[s[0] - 0.5], (s[1:] + s[:-1]) / 2, [s[-1] + 0.5]])
    best = np.flatnonzero(errors == errors.min())
    gaps = np.concatenate([[0.5], np.diff(s), [0.5]])[best]
    cut = float(edge[best[np.argmax(gaps)]])
    return Model(model.beta, model.bias, 10.0, -10.0 * cut)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of a fixed sample: at most SAMPLE labelled documents of each class, the first by a hash of the id."""
    d = pick(docs, id_col, text_col).toDF("doc_id", "text")
    known = pick(labels, id_col, label_col).toDF("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (1, 0)]
    found = d.where(F.length("text") <= LONGEST).join(F.broadcast(some[0].union(some[1])), "doc_id")
    # an exchange, so that the scan and the join stay parallel and the sample alone meets in one task
    return found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic")


def held_out(id_col: str):
    """Rows that training never sees: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """fit() on training_rows(), whose size has a fixed bound, in one task; what comes back is the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for b in small(batches):
            texts += b.column(0).to_pylist()
            toxic += b.column(1).to_pylist()
        m = fit(texts, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([m.beta.tobytes()], pa.binary()), *[pa.array([float(v)]) for v in (m.bias, m.slope, m.shift)]], ["beta", "bias", "slope", "shift"])

    rows = training_rows(docs, labels, id_col, text_col, label_col)
    found = rows.mapInArrow(tidy(run), "beta binary, bias double, slope double, shift double").first()
    if found is None:
        return fit([], [])
    return Model(np.frombuffer(found["beta"], np.float32), found["bias"], found["slope"], found["shift"])


class Scorer:
    """Scores of whole texts by one model; keeps the decisions on up to KEPT strings."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m, found = self.model, [strings(t) for t in texts]
        new = list(set().union(*found) - self.known.keys())
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = list(set().union(*found))
        for at in range(0, len(new), 4096):
            self.known.update(zip(new[at : at + 4096], m.decisions(new[at : at + 4096]).tolist(), strict=True))
        return m.probability(np.array([max(m.bias, *map(self.known.__getitem__, ws), m.bias) for ws in found]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the calibrated decision on the most toxic sentence of the whole text.

    Texts without a string, null ones included, get the score of the bias. Null ids, repeated rows and empty tables
    pass through; further columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scorer.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores below the limit; null and empty texts score the bias and stay."""
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in small(batches):
            yield b.filter(pa.array(scorer.scores(b.column(at).to_pylist()) < limit))

    return docs.mapInArrow(tidy(run), docs.schema)
