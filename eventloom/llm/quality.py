"""Quality rules: counts of every text and a calibrated hashed n-gram classifier.

Word and character n-grams of whole texts are hashed; a logistic regression over
their relative frequencies is trained on labelled rows, its scores are turned into
probabilities on labelled rows that it wasn't trained on, and documents are judged
in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common

#: Least words, and most percent of words in repeated windows, of a text that passes the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Words of a window that counts as repeated.
WINDOW = 5
#: A document is kept from this calibrated probability of good quality on.
KEEP_FROM = 0.5
#: The classifier is fitted on this many labelled rows at most, those of least hashed doc_id;
TRAINING_ROWS = 1200
#: one in so many of them calibrates.
CALIBRATION_SHARE = 4
#: Hash buckets for each kind of n-gram.
BUCKETS = 1 << 18
#: n of word and of character n-grams.
WORD_NS, CHAR_NS = (1, 2), (3, 5)
SCALE = 50.0
STEP_BYTES = 1 << 20
#: Features that a step of the fit takes at once.
STEP_FEATURES = 1 << 17
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen, covered = Counter(grams), bytearray(n)
        for i, g in enumerate(grams):
            if seen[g] > 1:
                covered[i : i + WINDOW] = b"\1" * WINDOW
        repeated = sum(covered)
    return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def _windows(values: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Hash bucket of every window of n values."""
    if len(values) < n:
        return np.empty(0, np.int64)
    out = np.full(len(values) - n + 1, salt, np.uint64)
    for i in range(n):
        out = (out ^ values[i : len(values) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & np.uint64(BUCKETS - 1)).astype(np.int64)


def hashed(texts: list[str], words: list[list[bytes]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: buckets of all windows of the texts in a row, and each text's first window and number of windows."""
    out = []
    units = (
        (WORD_NS, np.fromiter((crc32(w) for ws in words for w in ws), np.uint64), [len(ws) for ws in words]),
        (CHAR_NS, np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), [len(t) for t in texts]),
    )
    for ns, values, lengths in units:
        size = np.asarray(lengths, np.int64)
        first = np.cumsum(size) - size
        for n in ns:
            out.append((_windows(values, n, len(out) + 1), first, np.maximum(size - n + 1, 0)))
    return out


@dataclass
class Model:
    """Weights by kind and bucket, a bias, and the calibration of the score."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def scores(self, texts: list[str], words: list[list[bytes]]) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, (buckets, first, number) in enumerate(hashed(texts, words)):
            sums = np.concatenate(([0.0], np.cumsum(self.weights[k][buckets], dtype=np.float64)))
            end = np.minimum(first + number, len(buckets))
            z += SCALE * (sums[end] - sums[np.minimum(first, len(buckets))]) / np.maximum(number, 1)
        return z

    def probabilities(self, texts: list[str], words: list[list[bytes]]) -> np.ndarray:
        """Calibrated probability of good quality of each text."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.scores(texts, words) + self.shift, -50, 50)))


def fit(rows: list[tuple[list[tuple[np.ndarray, np.ndarray]], int]], rounds: int = 60) -> Model:
    """Logistic regression by full-gradient steps scaled for each weight, then Platt's calibration.

    ``rows``: per text, for each kind its distinct buckets and their relative
    frequencies; and the label.  Every ``CALIBRATION_SHARE``-th row calibrates.
    With one label only, all get its probability.
    """
    kinds = len(WORD_NS) + len(CHAR_NS)
    labels = np.array([y for _, y in rows], np.float64)
    if not len(rows) or labels.min() == labels.max():
        sure = 1.0 if not len(rows) or labels.max() else -1.0
        return Model(np.zeros((kinds, BUCKETS), np.float32), 10 * sure)
    held = np.arange(len(rows)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    if labels[~held].min() == labels[~held].max() or not held.any():
        held[:] = False
    sizes = np.array([sum(len(b) for b, _ in x) for x, _ in rows], np.int64)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    idx, val = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    at = 0
    for x, _ in rows:
        for k, (b, v) in enumerate(x):
            np.add(b, k * BUCKETS, out=idx[at : at + len(b)])
            np.multiply(SCALE, v, out=val[at : at + len(b)])
            at += len(b)
    # a few rows at a time, so that the driver holds little beside the features
    firsts = [0]
    for i in range(1, len(rows)):
        if ends[i + 1] - ends[firsts[-1]] > STEP_FEATURES:
            firsts.append(i)
    parts = [(i, j, slice(ends[i], ends[j])) for i, j in zip(firsts, [*firsts[1:], len(rows)])]
    row = lambda i, j: np.repeat(np.arange(j - i), sizes[i:j])
    w, bias = np.zeros(kinds * BUCKETS), 0.0
    squares, bias_squares = np.full(kinds * BUCKETS, 1e-12), 1e-12

    def score() -> np.ndarray:
        return bias + np.concatenate([np.bincount(row(i, j), weights=w[idx[s]] * val[s], minlength=j - i) for i, j, s in parts])

    for _ in range(rounds):
        g = np.where(held, 0.0, 1 / (1 + np.exp(-np.clip(score(), -50, 50))) - labels) / max(1, (~held).sum())
        step = np.zeros(len(w))
        for i, j, s in parts:
            np.add.at(step, idx[s].astype(np.intp), g[i:j][row(i, j)] * val[s])
        step += 1e-7 * w
        squares += step * step
        w -= 0.03 * step / np.sqrt(squares)
        bias_squares += g.sum() ** 2
        bias -= 0.03 * g.sum() / np.sqrt(bias_squares)
    z = score()
    part = held if held.any() and labels[held].min() != labels[held].max() else ~held
    slope, shift = _platt(z[part], labels[part])
    return Model(w.reshape(kinds, BUCKETS).astype(np.float32), float(bias), slope, shift)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through scores, with Platt's smoothed labels, by Newton's method."""
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    loss = lambda th: np.mean(np.logaddexp(0, x @ th) - t * (x @ th))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - t))
        rate = 1.0
        while rate > 1e-4 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(step).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """A model of ``labels.quality`` (1 good, 0 bad) from at most ``rows`` labelled documents.

    The rows are those of least hashed doc_id among labelled ones, each with its
    whole text (the least, where rows share an id).  Features are counted by the executors; the driver gets distinct
    buckets with frequencies, which the number of rows bounds.
    """
    labelled = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = labelled.orderBy(F.xxhash64("doc_id", F.lit("quality-1")), "doc_id").limit(rows)
    sample = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality")  # of rows that share an id one trains

    def features(batches: Iterator) -> Iterator:
        for batch in common.pieces(batches, "text", STEP_BYTES):
            texts = batch.column(1).to_pylist()
            data = hashed(texts, [t.encode("utf-8", "replace").split() for t in texts])
            packed = []
            for i in range(len(texts)):
                parts = []
                for buckets, first, number in data:
                    b, c = np.unique(buckets[first[i] : first[i] + number[i]], return_counts=True)
                    parts += [np.array([len(b)], "<i4").tobytes(), b.astype("<i4").tobytes(), (c / max(1, number[i])).astype("<f4").tobytes()]
                packed.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "quality", "features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(features, f"doc_id {kind}, quality int, features binary").toArrow()
    model = fit([(_unpacked(got.column(2)[i].as_buffer()), got.column(1)[i].as_py()) for i in pc.sort_indices(got.column(0)).to_pylist()])
    del got
    common.let_go()
    return model


def _unpacked(packed: pa.Buffer) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and frequencies of each kind, as views."""
    at, x = 0, []
    for _ in range(len(WORD_NS) + len(CHAR_NS)):
        n = int(np.frombuffer(packed, "<i4", 1, at)[0])
        x.append((np.frombuffer(packed, "<i4", n, at + 4), np.frombuffer(packed, "<f4", n, at + 4 + 4 * n)))
        at += 4 + 8 * n
    return x


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts and verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, and quality (the calibrated probability).  A null text has
    no words and so fails the base rules.  Rows are independent: repeated rows
    repeat, an empty table gives none.  Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights for each kind, whatever the data
    name = uuid.uuid4().hex

    def judged(batches: Iterator) -> Iterator:
        kept_model = lambda: common.kept(name, lambda: shared.value)

        for batch in common.pieces(batches, "text", STEP_BYTES):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [t.encode("utf-8", "replace").split() for t in texts]
            counts = [base_counts(t, w) for t, w in zip(texts, words)]
            failed = [c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEATED * c[0] for c in counts]
            good = kept_model().probabilities(texts, words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *(pa.array(c, pa.int64()) for c in zip(*counts)),
                    pa.array(failed, pa.bool_()),
                    pa.array([not f and bool(g >= keep_from) for f, g in zip(failed, good)], pa.bool_()),
                    pa.array(good, pa.float64()),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"],
            )

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return rows.mapInArrow(judged, f"doc_id {kind}, {counts}, base_failed boolean, kept boolean, quality double")


def keep_good(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that ``judge`` would keep, with all their columns; no row is moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    at = docs.columns.index("text")

    def kept(batches: Iterator) -> Iterator:
        kept_model = lambda: common.kept(name, lambda: shared.value)

        for batch in common.pieces(batches, "text", STEP_BYTES):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            words = [t.encode("utf-8", "replace").split() for t in texts]
            good = kept_model().probabilities(texts, words) >= keep_from
            for i, (t, w) in enumerate(zip(texts, words)):
                if good[i]:
                    good[i] = len(w) >= LEAST_WORDS and 100 * base_counts(t, w)[4] <= MOST_REPEATED * len(w)
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` row with its counts, base_failed and kept."""
    docs = common.table(spark, sf_dir, "documents")
    return judge(docs, train(docs, common.table(spark, sf_dir, "labels")))
