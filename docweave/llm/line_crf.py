"""Document quality from a linear-chain conditional random field over lines.

Every line with a visible character is labelled good or bad.  Its features are
rates of character classes, word lengths, repetition, and whether the line has
occurred before in its document, each also of the line before and behind.  The
marginals of the two labels come from the forward-backward recursion; weighted
by line length their mean is a document's share of bad text, which a logistic
curve turns into a score from 0 (bad) to 1.

Only document labels exist.  Training starts with every line labelled as its
document and, after a first fit, takes lines of bad documents that look good as
good (but leaves the worst of each document bad) and fits again.

The model is fitted on at most ``MAX_TRAIN_DOCS`` labelled documents, chosen by a
hash of doc_id, of ``MAX_TRAIN_CHARS`` characters in all; long ones are cut into pieces of ``TRAIN_LINES`` lines there.
Scoring takes whole texts.  A text without lines has no bad part, so it gets the
score of a share of 0.  Without labels of both kinds every score is 0.5.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import batches_of, carried, small_batches, tidy

MAX_TRAIN_DOCS, MAX_TRAIN_CHARS = 4000, 50_000_000
TRAIN_LINES = 32
BATCH_CHARS = 1_000_000
FOLDS, THRESHOLD = 5, 0.3
OTHER, LETTER, UPPER, DIGIT, SYMBOL, SHOUT, SPACE, POINT = range(8)
SYMBOLS = "#*$%&|<>"
N_FEATURES = 11
_TOP = 0x3000


def _class_table() -> np.ndarray:
    table = np.full(_TOP, OTHER, np.uint8)
    for c in range(_TOP):
        kind = unicodedata.category(chr(c))
        table[c] = UPPER if kind == "Lu" else LETTER if kind[0] == "L" else DIGIT if kind == "Nd" else POINT if kind[0] == "P" else SPACE if kind == "Zs" else OTHER
    table[[9, 10, 11, 12, 13]] = SPACE
    table[[ord(c) for c in SYMBOLS]] = SYMBOL
    table[[ord(c) for c in "!?"]] = SHOUT
    table[_TOP - 1] = LETTER  # stands for all code points above, most of them letters
    return table


CLASSES = _class_table()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lengths in characters, number of lines of each text)."""
    lines: list[str] = []
    counts, words, unique, same, again = [], [], [], [], []
    for x in texts:
        own = [s for s in x.split("\n") if s and not s.isspace()]
        seen: set[str] = set()
        for s in own:
            w = s.split()
            words.append(len(w))
            unique.append(len(set(w)))
            same.append(sum(map(eq, w, w[1:])))
            again.append(s in seen)
            seen.add(s)
        counts.append(len(own))
        lines += own
    n = len(lines)
    if not n:
        return np.zeros((0, 3 * N_FEATURES)), np.zeros(0), np.array(counts, np.int64)
    code = np.frombuffer("\n".join(lines).encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    kinds = CLASSES[np.minimum(code, _TOP - 1)]
    chars = np.array([len(s) for s in lines], np.float64)
    starts = np.concatenate([[0], np.cumsum(chars + 1)[:-1]]).astype(np.int64)
    per = {k: np.add.reduceat((kinds == k).astype(np.uint32), starts).astype(np.float64) for k in (LETTER, UPPER, DIGIT, SYMBOL, SHOUT, OTHER)}
    nw = np.maximum(np.array(words, np.float64), 1)
    letters = np.maximum(per[LETTER] + per[UPPER], 1)
    own = np.stack([
        np.ones(n), np.minimum(per[SYMBOL] / nw, 3), np.where(letters > 8, per[UPPER] / letters, 0), np.minimum(per[SHOUT] / nw, 3), per[DIGIT] / chars,
        per[OTHER] / chars, np.minimum(chars / nw / 10, 3), np.log1p(nw) / 5, np.where(nw >= 8, 1 - np.array(unique) / nw, 0), np.array(same) / nw, np.array(again, np.float64),
    ], axis=1)
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum([c for c in counts if c])
    last[ends - 1] = True
    first[np.concatenate([[0], ends[:-1]])] = True
    before = np.vstack([np.zeros((1, N_FEATURES)), own[:-1]])
    behind = np.vstack([own[1:], np.zeros((1, N_FEATURES))])
    before[first] = 0
    behind[last] = 0
    return np.hstack([own, before, behind]), chars, np.array(counts, np.int64)


@dataclass
class Model:
    """Weights of "bad" against "good", log transition weights [from, to], and the curve's offset and slope."""

    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def shares(self, texts: list[str]) -> np.ndarray:
        """The length-weighted share of bad text of each."""
        x, chars, counts = line_features(texts)
        bad, _, _ = forward_backward(x @ self.weights, self.moves, counts)
        return weighted_share(bad, chars, counts)

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a + b * self.shares(texts))))


def weighted_share(bad: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(chars)])
    part = np.concatenate([[0], np.cumsum(bad * chars)])
    size = total[ends] - total[ends - counts]
    return np.where(size > 0, (part[ends] - part[ends - counts]) / np.maximum(size, 1), 0.0)


def forward_backward(scores: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(marginal of bad per line, summed pair marginals [from, to], summed log partition) of chains laid end to end.

    All chains advance together, longest first; each step handles those that
    still have a line.  Messages are normalised at every step.
    """
    bad = np.zeros(len(scores))
    pairs = np.zeros((2, 2))
    used = np.flatnonzero(counts)
    if not len(used):
        return bad, pairs, 0.0
    order = used[np.argsort(-counts[used], kind="stable")]
    length = counts[order]
    start = (np.cumsum(counts) - counts)[order]
    shift = np.maximum(scores, 0)
    local = np.stack([np.exp(-shift), np.exp(scores - shift)], axis=1)
    move = np.exp(moves)
    alpha = np.zeros((len(scores), 2))
    active = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]))]
    partition = float(shift.sum())
    for t, k in enumerate(active):
        at = start[:k] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ move) * local[at]
        z = a.sum(axis=1, keepdims=True)
        partition += float(np.log(z).sum())
        alpha[at] = a / z
    beta = np.ones((len(order), 2))
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        if t + 1 < len(active):
            k2 = active[t + 1]
            ahead = local[at[:k2] + 1] * beta[:k2]
            pair = alpha[at[:k2]][:, :, None] * move[None] * ahead[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            pairs += pair.sum(axis=0)
            b = ahead @ move.T
            beta[:k2] = b / b.sum(axis=1, keepdims=True)
        m = alpha[at] * beta[:k]
        bad[at] = m[:, 1] / m.sum(axis=1)
    return bad, pairs, partition


def _fit_chain(x: np.ndarray, y: np.ndarray, counts: np.ndarray, steps: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the greatest penalised likelihood, by Adam on the whole sample."""
    scale = np.maximum(x.std(axis=0), 1e-3)
    scale[x.std(axis=0) == 0] = 1.0
    x = x / scale
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts[counts > 0])[:-1]] = False
    inner[0] = False
    to = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[to - 1], y[to]), 1)
    n = max(len(y), 1)
    grads = [np.zeros_like(w), np.zeros_like(moves)]
    squares = [np.zeros_like(w), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        bad, pairs, _ = forward_backward(x @ w, moves, counts)
        for i, (p, g) in enumerate(((w, x.T @ (y - bad) / n - decay * w), (moves, (seen - pairs) / n - decay * moves))):
            grads[i] = 0.9 * grads[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            p += 0.1 * (grads[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8)
    return w / scale, moves


def _fit_curve(share: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the share, by Newton's method with a small penalty."""
    design = np.stack([np.ones(len(share)), share], axis=1)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(design @ theta)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, design.T @ (good - p) - 0.1 * theta)
    return float(theta[0]), float(min(theta[1], 0.0))


def fit(texts: list[str], good: list[int]) -> Model | None:
    """The model of labelled texts; None unless both labels occur."""
    if len(set(good)) < 2:
        return None
    x, chars, counts = line_features(texts)
    label = np.repeat(1 - np.array(good), counts)
    pieces = np.array([min(TRAIN_LINES, c - lo) for c in counts for lo in range(0, c, TRAIN_LINES)], np.int64)
    w, moves = _fit_chain(x, label, pieces)
    bad, _, _ = forward_backward(x @ w, moves, pieces)
    ends = np.cumsum(counts)
    for end, c, g in zip(ends, counts, good, strict=True):
        if not g and c:
            own = slice(end - c, end)
            worst = bad[own].max()
            label[own] = (bad[own] >= min(0.5, worst)).astype(label.dtype)
    w, moves = _fit_chain(x, label, pieces)
    bad, _, _ = forward_backward(x @ w, moves, counts)
    return Model(w, moves, _fit_curve(weighted_share(bad, chars, counts), np.array(good, np.float64)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAIN_DOCS, max_chars: int = MAX_TRAIN_CHARS) -> Model | None:
    """A model from labelled documents that aren't held out.

    The sample's ids are bounded by ``max_docs``, its texts by ``max_chars`` too:
    texts come in the order of a hash until that many characters are there.  Of a
    doc_id with several texts the least hash counts, of one with several labels
    the least.  The text join sends those few ids to the documents.
    """
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not sample:
        return None
    ids = docs.sparkSession.createDataFrame(sample, usable.schema)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = found.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), F.length("text").cast("long").alias("size"))).alias("own")).select("doc_id", "quality", "own.*").collect()
    room, chosen = max_chars, []
    for r in sorted(one, key=lambda r: (r.hash, r.doc_id)):
        if r.size <= room:
            room -= r.size
            chosen.append(r.doc_id)
    if not chosen:
        return None
    few = docs.sparkSession.createDataFrame([(d,) for d in chosen], docs.select("doc_id").schema)
    rows = found.join(F.broadcast(few), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).collect()
    rows = sorted(rows, key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.quality) for r in rows])


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """keep columns and score of every row; whole texts, no shuffle.

    Null and empty texts get the score of a share of 0; a carried column named
    score becomes in_score.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    held = {c: f"k_{i}" for i, c in enumerate(keep)}
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], F.col(text).alias("__text"))
    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.drop("__text").schema) + "m_score double"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [x or "" for x in batch.column("__text").to_pylist()]
            scores = [s for part in batches_of(texts, BATCH_CHARS) for s in (model.scores(texts[part]) if model else [0.5] * (part.stop - part.start))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in held.values()), pa.array(scores, pa.float64())], names=[*held.values(), "m_score"])

    small_batches(docs.sparkSession)
    names = carried(keep, ["score"])
    return rows.mapInArrow(tidy(run), schema).select(*[F.col(k).alias(names[c]) for c, k in held.items()], F.col("m_score").alias("score"))
