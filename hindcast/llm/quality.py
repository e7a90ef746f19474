"""Quality classifier: gated-attention multiple-instance learning.

A document is a bag of passages of 64 words.  Each passage is described by surface
features (shares of character classes, word shapes, repetition), encoded by a
learned layer, and weighed by learned gated attention; the weighted sum is scored.
Only document labels are known.  The model is fitted by gradient descent on a
bounded sample of labelled rows, and every passage of every document is scored in
Arrow batches.

Defined cases: null counts as empty; a text without words is one passage of no
words, which the model scores like any other; repeated rows score alike; labels of
null quality and ids without a text are not learned from; without labels of both
kinds every score is the share of label 1 among those there are, 0.5 without any;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm._spark import set_aside, set_back
from hindcast.llm._text import Words, buffers, slices

PASSAGE_WORDS = 64
#: Bounds of the training sample: labelled rows, and code points of one.
SAMPLE_ROWS = 4_000
SAMPLE_CHARS = 50_000
HIDDEN, ATTENTION = 16, 8
THRESHOLD = 0.3

_PUNCT = [i for i in range(33, 127) if not chr(i).isalnum()]
_CLASS = np.zeros(256, np.int64)
for _i, _c in enumerate(_PUNCT):
    _CLASS[_c] = 6 + _i
for _lo, _hi, _k in ((48, 58, 1), (65, 91, 2), (97, 123, 3), (128, 192, 4), (192, 256, 5)):
    _CLASS[_lo:_hi] = _k
_CLASS[10] = 6 + len(_PUNCT)
N_CLASSES = 7 + len(_PUNCT)
N_FEATURES = N_CLASSES + 9


def passage_features(column: pa.Array, passage: int = PASSAGE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(features, first passage of each row and one past the last) of slices of texts."""
    for low, high in slices(column):
        raw, offsets = buffers(column.slice(low, high - low))
        words = Words(raw, offsets)
        counts = np.diff(words.bounds)
        bags = np.concatenate([[0], np.cumsum(np.maximum(1, -(-counts // passage)))])
        n = bags[-1]
        nth = np.arange(len(words.start)) - np.repeat(words.bounds[:-1], counts)
        of_word = np.repeat(bags[:-1], counts) + nth // passage
        out = np.zeros((n, N_FEATURES), np.float64)
        if len(raw):
            # bytes up to the next passage's first word belong to a passage
            first = np.repeat(offsets[:-1], np.diff(bags)).astype(np.int64)
            heads = nth % passage == 0
            first[of_word[heads & (nth > 0)]] = words.start[heads & (nth > 0)]
            lengths = np.diff(np.append(first, len(raw)))
            of_byte = np.repeat(np.arange(n), lengths)
            hist = np.bincount(of_byte * N_CLASSES + _CLASS[raw], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
            out[:, :N_CLASSES] = np.sqrt(hist / np.maximum(1, lengths)[:, None])
        if len(words.start):
            size = (words.end - words.start).astype(np.float64)
            per = np.bincount(of_word, minlength=n).astype(np.float64)
            some = np.maximum(1, per)
            mean = np.bincount(of_word, size, n) / some
            hashes = words.hashes()
            order = np.lexsort((hashes, of_word))
            same = (hashes[order][1:] == hashes[order][:-1]) & (of_word[order][1:] == of_word[order][:-1])
            repeats = np.bincount(of_word[order][1:][same], minlength=n)
            head, tail = _CLASS[raw[words.start]], _CLASS[raw[words.end - 1]]
            second = _CLASS[raw[np.minimum(words.start + 1, words.end - 1)]]
            share = lambda mask: np.bincount(of_word[mask], minlength=n) / some
            out[:, N_CLASSES:] = np.column_stack([
                np.minimum(mean, 40) / 10, np.sqrt(np.maximum(0, np.bincount(of_word, size**2, n) / some - mean**2)).clip(0, 40) / 10,
                repeats / some, share(size <= 3), share(size >= 12), share((head == 2) & (second == 2)), share(tail > 5), share(head > 5), np.minimum(per, passage) / passage,
            ])
        yield out, bags


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each bag; bags are bounds in the rows of x."""
        if self.constant is not None:
            return np.full(len(bags) - 1, self.constant)
        return _forward(self.w, (x - self.mean) / self.scale, bags)[0]


def _forward(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray):
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t = np.tanh(h @ w["value"])
    g = 1 / (1 + np.exp(-(h @ w["gate"])))
    raw = (t * g) @ w["attend"]
    start, counts = bags[:-1], np.diff(bags)
    e = np.exp(raw - np.repeat(np.maximum.reduceat(raw, start), counts))
    a = e / np.repeat(np.add.reduceat(e, start), counts)
    z = np.add.reduceat(a[:, None] * h, start)
    p = 1 / (1 + np.exp(-np.clip(z @ w["score"] + w["score0"], -30, 30)))
    return p, h, t, g, a, z


def shapes(features: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights."""
    return {
        "encode": (features, HIDDEN), "encode0": (HIDDEN,), "value": (HIDDEN, ATTENTION), "gate": (HIDDEN, ATTENTION),
        "attend": (ATTENTION,), "score": (HIDDEN,), "score0": (),
    }


def gradient(w: dict[str, np.ndarray], x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of whole bags; classes weigh the same."""
    share, start, counts = y.mean(), bags[:-1], np.diff(bags)
    p, h, t, g, a, z = _forward(w, x, bags)
    dz_out = (p - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    dz = np.repeat(dz_out[:, None] * w["score"], counts, 0)
    da = (dz * h).sum(1)
    draw = a * (da - np.repeat(np.add.reduceat(a * da, start), counts))
    dt, dg = draw[:, None] * w["attend"] * g * (1 - t * t), draw[:, None] * w["attend"] * t * g * (1 - g)
    du = (a[:, None] * dz + dt @ w["value"].T + dg @ w["gate"].T) * (1 - h * h)
    return {
        "encode": x.T @ du, "encode0": du.sum(0), "value": h.T @ dt, "gate": h.T @ dg,
        "attend": (t * g).T @ draw, "score": z.T @ dz_out, "score0": dz_out.sum(),
    }


def fit(x: np.ndarray, bags: np.ndarray, y: np.ndarray, steps: int = 400, seed: int = 3) -> Model:
    """Adam on :func:`gradient`, with a small weight decay."""
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(x.shape[1]), np.ones(x.shape[1]), {}, float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(0), x.std(0) + 0.05
    x = (x - mean) / scale
    rng = np.random.default_rng(seed)
    w = {k: rng.normal(0, 0.15, s) for k, s in shapes(x.shape[1]).items()}
    m, v = {k: np.zeros(np.shape(x)) for k, x in w.items()}, {k: np.zeros(np.shape(x)) for k, x in w.items()}
    for step in range(1, steps + 1):
        grad = gradient(w, x, bags, y)
        for k in w:
            d = grad[k] + 1e-4 * w[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.99 * v[k] + 0.01 * d * d
            w[k] = w[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(mean, scale, w)


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most SAMPLE_ROWS labelled rows outside the held-out fold.

    The sample is the rows of the smallest hashes, so it does not depend on the
    order of the input; their passages' features come to the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label)).cast("int").alias("_label"))
    order = F.md5(F.col(doc_id).cast("string"))
    # ids are thinned to the sample before any text moves; SAMPLE_ROWS bounds the broadcast
    able = docs.where(F.char_length(F.coalesce(F.col(text), F.lit(""))) <= SAMPLE_CHARS).select(F.col(doc_id))
    ids = able.join(known, F.col(doc_id) == F.col("_id")).select("_id", "_label", order.alias("_order")).distinct()
    chosen = ids.orderBy("_order").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(doc_id), F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col(doc_id) == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x, bags in passage_features(batch.column(2)):
                n = len(bags) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([x[bags[i] : bags[i + 1]].astype("<f4").tobytes() for i in range(n)], pa.binary())],
                    ["id", "label", "features"],
                )
                at += n

    got = rows.where(F.char_length("_text") <= SAMPLE_CHARS).select("_id", "_label", "_text").mapInArrow(run, "id long, label int, features binary").collect()
    got.sort(key=lambda r: (r.id, r.features))
    if not got:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, 0.5)
    parts = [np.frombuffer(r.features, "<f4").reshape(-1, N_FEATURES).astype(np.float64) for r in got]
    bags = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return fit(np.concatenate(parts), bags, np.array([r.label for r in got], float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added; no other column is read."""
    schema = docs.drop(out).schema.add(out, "double")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = sent.value
        for batch in batches:
            scores = [fitted.score(x, bags) for x, bags in passage_features(batch.column(text))]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, out])

    return docs.drop(out).mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, their columns unchanged, whatever their names."""
    own = set_aside(docs)
    scored = score(own, train(own, labels), out="_score")
    return set_back(scored.where(F.col("_score") >= threshold), docs.columns)
