"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line is labelled good or bad. Its features are shares of kinds of characters,
word and line length, whether the line repeats in its document, and how well the
document compresses, together with the same figures of the lines before and after
it. Forward-backward marginals, weighted by line length, give the document's share
of good text, and a logistic curve fitted on the training documents turns it into
the score.

The field is fitted on a bounded sample of labelled documents (`SAMPLE` texts, `SAMPLE_LINES` lines of each); scoring is
one pass over all texts without a shuffle.

Defined results
    null text: as the empty text, which is one empty line. Labels that are null are
    not learnt from; several labels of one id are each learnt from. Without labels
    of both kinds the score is their smoothed share. Repeated rows get equal scores.
    Empty table: empty result. Other columns are never features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are learnt from, and of each so many lines.
SAMPLE, SAMPLE_LINES = 4000, 2000
CHUNK_BYTES = 1 << 20
#: Kinds of bytes: other, lower case, upper case, digits, blanks, sentence marks, rare marks, exclamations, beyond ASCII.
KINDS = 9
BASE = 11


def _kinds() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for kind, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", b".,;:?'\"()-", b"#$%&*|<>{}[]^~=+@\\/_`", b"!"), 1):
        table[list(members)] = kind
    table[128:] = 8
    return table


_TABLE = _kinds()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, one after the other, and where each row starts (nulls are empty)."""
    column = column.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def features(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features (lines, 2 * BASE), line lengths, and where each document's lines start.

    ``starts`` has the first byte of each document and the end.
    """
    n = len(starts) - 1
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([starts[:-1], breaks + 1]), kind="stable")
    # A document that ends in a line break has an empty line at its end, which starts
    # where the next document does; the sort keeps as many starts as there are lines.
    per_doc = np.bincount(np.searchsorted(starts, breaks, "right") - 1, minlength=n) + 1
    doc = np.repeat(np.arange(n), per_doc)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    end = np.append(begin[1:], len(data))
    length = end - begin
    line = np.repeat(np.arange(len(begin)), length)
    counts = np.bincount(line * KINDS + _TABLE[data], minlength=len(begin) * KINDS).reshape(-1, KINDS).astype(np.float64)
    raw = data.tobytes()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), np.uint64, len(begin)) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
    size = np.diff(starts)
    packed = np.array([len(zlib.compress(raw[a:b], 1)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
    letters = counts[:, 1] + counts[:, 2] + counts[:, 8]
    whole = np.maximum(length, 1)
    x = np.empty((len(begin), BASE))
    x[:, 0] = counts[:, 2] / np.maximum(letters, 1)
    for k, kind in enumerate((3, 4, 5, 6, 7, 8), 1):
        x[:, k] = counts[:, kind] / whole
    x[:, 7] = np.log1p(letters / (counts[:, 4] + 1))
    x[:, 8] = np.log1p(length)
    x[:, 9] = times[at] > 1
    x[:, 10] = ((packed - 8) / np.maximum(size, 1))[doc].clip(0, 1.5)
    before, after = np.arange(len(x)) - 1, np.arange(len(x)) + 1
    before[first[:-1]] = first[:-1]  # the first and last line are their own neighbours
    after[first[1:] - 1] = first[1:] - 1
    return np.concatenate([x, (x[before] + x[after]) / 2], axis=1), length, first


def forward_backward(score: np.ndarray, first: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals (lines, 2) of the states bad and good, and of the moves (lines, 2, 2) to the next line.

    ``score`` is each line's log potential of good over bad. All documents advance together.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    active = np.searchsorted(-count[order], -np.arange(1, int(count.max(initial=0)) + 1), "right")
    e = np.stack([np.ones(len(score)), np.exp(np.clip(score, -30, 30))], axis=1)
    t, alpha, beta = np.exp(moves), np.empty((len(score), 2)), np.ones((len(score), 2))
    heads = first[:-1][order]
    for k, m in enumerate(active):
        at = heads[:m] + k
        a = (np.exp(start) if k == 0 else alpha[at - 1] @ t) * e[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for k in range(len(active) - 2, -1, -1):
        at = heads[: active[k + 1]] + k
        b = (e[at + 1] * beta[at + 1]) @ t.T
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    pair = np.zeros((len(score), 2, 2))
    at = np.ones(len(score), bool)
    at[first[1:] - 1] = False
    at = np.flatnonzero(at)
    x = alpha[at][:, :, None] * t * (e[at + 1] * beta[at + 1])[:, None, :]
    pair[at] = x / x.sum((1, 2), keepdims=True)
    return p / p.sum(1, keepdims=True), pair


@dataclass(frozen=True)
class Model:
    """A fitted field: scaling, line weights, moves between states, and the score's curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray
    slope: float
    offset: float

    def lines(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The probability of each line to be good."""
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        return forward_backward(z @ self.weights, first, self.moves, self.start)[0][:, 1]

    def scores(self, good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * share(good, length, first) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def share(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log odds of the share of good text, lines weighted by length."""
    w = length + 1.0
    p = (np.add.reduceat(w * good, first[:-1]) / np.add.reduceat(w, first[:-1])).clip(1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def train(x: np.ndarray, length: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> Model:
    """Fit the field to documents of lines ``x`` with 0/1 ``label``; every line takes its document's."""
    rate = (label.sum() + 1) / (len(label) + 2)
    if not 0 < label.sum() < len(label):
        d = x.shape[1] if x.ndim == 2 and x.shape[1] else 2 * BASE
        return Model(np.zeros(d), np.ones(d), np.zeros(d + 1), np.zeros((2, 2)), np.zeros(2), 0.0, float(np.log(rate / (1 - rate))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    line = np.repeat(label, np.diff(first))
    state = np.stack([1 - line, line], axis=1).astype(float)
    inner = np.ones(len(x), bool)
    inner[first[1:] - 1] = False
    seen = np.diag([(inner & (line == s)).sum() for s in (0, 1)]).astype(float)
    theta = np.zeros(z.shape[1] + 6)
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), z.shape[1]
    for k in range(1, rounds + 1):
        p, pair = forward_backward(z @ theta[:d], first, theta[d : d + 4].reshape(2, 2), theta[d + 4 :])
        g = np.concatenate([z.T @ (state - p)[:, 1], (seen - pair.sum(0)).ravel(), (state - p)[first[:-1]].sum(0)]) / len(label) - decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    model = Model(mean, scale, theta[:d], theta[d : d + 4].reshape(2, 2), theta[d + 4 :], 1.0, 0.0)
    s = share(model.lines(x, first), length, first)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve, lightly held to slope 1
        q = _sigmoid(a * s + b)
        r, h = label - q, q * (1 - q) + 1e-9
        grad = np.array([(r * s).sum() - 0.1 * (a - 1), r.sum() - 0.1 * b])
        hess = np.array([[(h * s * s).sum() + 0.1, (h * s).sum()], [(h * s).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = max(0.05, a + float(step[0])), b + float(step[1])
    return Model(mean, scale, model.weights, model.moves, model.start, a, b)


def held_out(doc_id: Column) -> Column:
    """Whether labels of this row are kept for testing: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of bounded size (a single long text is one) with their bytes and starts."""
    data, starts = flat(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + CHUNK_BYTES, "right")) - 1)
        yield a, b, data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
        a = b


def _line_rows(most_lines: int):
    """Features of labelled texts; of a text with more than ``most_lines`` lines, a stretch of so many from the middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in _chunks(batch.column(0)):
                x, length, first = features(data, starts)
                spans = [(m := (p + q) // 2, max(p, m - most_lines // 2), min(q, m - most_lines // 2 + most_lines)) if q - p > most_lines else (p, p, q) for p, q in zip(first, first[1:], strict=False)]
                rows = [x[p:q].astype(np.float32).tobytes() for _, p, q in spans]
                sizes = [length[p:q].astype(np.int64).tobytes() for _, p, q in spans]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(rows, pa.binary()), pa.array(sizes, pa.binary())], names=["quality", "x", "length"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = SAMPLE_LINES) -> Model:
    """A model from up to ``sample`` labelled texts that are not held out, of ``labels(doc_id, quality)``.

    Texts and labels are chosen by hashes of both, so the sample does not depend on
    tasks; repeated rows are one. What the driver gets is bounded by ``sample *
    most_lines`` lines. Scoring always takes whole texts.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("quality").isNotNull() & F.col("label_id").isNotNull() & ~held_out(F.col("label_id")))
        .distinct().orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(sample)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("label_id"))
    # An id may have any number of texts: again the first ``sample`` by hash, told apart without moving the texts.
    keys = texts.select(F.xxhash64("label_id", "text", "quality").alias("key")).distinct().orderBy("key").limit(sample)
    texts = texts.withColumn("key", F.xxhash64("label_id", "text", "quality")).join(F.broadcast(keys), "key", "left_semi").dropDuplicates(["key"]).select("text", "quality")
    rows = texts.mapInArrow(_line_rows(most_lines), "quality int, x binary, length binary").toArrow()
    x = [np.frombuffer(r, np.float32).reshape(-1, 2 * BASE).astype(np.float64) for r in rows["x"].to_pylist()]
    length = [np.frombuffer(r, np.int64) for r in rows["length"].to_pylist()]
    order = sorted(range(len(x)), key=lambda i: (len(x[i]), x[i].tobytes()))  # the sum's order must not depend on tasks
    x, length, label = [x[i] for i in order], [length[i] for i in order], rows["quality"].to_numpy()[order] if len(rows) else np.zeros(0)
    if not x:
        return train(np.zeros((0, 2 * BASE)), np.zeros(0), np.zeros(1, np.int64), np.zeros(0))
    first = np.concatenate([[0], np.cumsum([len(r) for r in x])])
    return train(np.concatenate(x), np.concatenate(length), first, label)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` per row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in _chunks(batch.column(1)):
                x, length, first = features(data, starts)
                score = model.scores(model.lines(x, first), length, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(score)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, score double")


def label_lines(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line, good, p_good`` for every line of ``docs(doc_id, text)``."""
    names = ["doc_id", "line", "good", "p_good"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in _chunks(batch.column(1)):
                x, _, first = features(data, starts)
                p = model.lines(x, first)
                doc = np.repeat(np.arange(a, b), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(np.arange(len(p)) - first[doc - a]), pa.array(p >= 0.5), pa.array(p)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, line bigint, good boolean, p_good double")


def keep_good(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, all columns as they are."""
    at = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, starts in _chunks(batch.column(at)):
                x, length, first = features(data, starts)
                yield batch.slice(a, b - a).filter(pa.array(model.scores(model.lines(x, first), length, first) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
