"""Quality classifier: Naive Bayes support vectors on n-gram indicators.

A text's indicators are its distinct word 1- and 2-grams, 4-grams of character classes, and
n-grams of the relation between neighbouring words (equal or not), hashed to BITS bits.
Each indicator is scaled by its log-count ratio between the classes, a text's vector is
scaled to unit length, and a linear hinge-loss model is fitted by dual coordinate descent.
A sigmoid, fitted on held-back margins, turns margins into scores.

The model is fitted on at most SAMPLE labelled rows, those with the smallest hash of their
id (a documented bound; one task holds them). Every text is scored whole, in one pass over
the table without a shuffle.

Defined results: null and empty texts have no indicators and get the score of the bias;
without labelled rows every score is 0.5, with one class only it is that class. A text
labelled twice counts twice. Rows that repeat an id are scored each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared, words

BITS = 19
SAMPLE = 6000
SMOOTHING, COST, EPOCHS = 1.0, 1.0, 20
# Character classes, by byte: lower case, upper case, digits, space, line end, other
# white space, bytes beyond ASCII, then groups of punctuation.
_CLASS = np.full(256, 15, dtype=np.uint64)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b"\n", b"\t\r\x0b\x0c", range(128, 256),
                             b".", b",;:", b"!?", b"|", b"#$%&*", b"-_=+~", b"\"'`", b"()[]{}<>/\\@^")):
    _CLASS[list(_chars)] = _i


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, indicator) of consecutive texts, sorted and distinct."""
    h, counts = words.text_hashes(data, offsets, lower=True)
    found = []
    for n in (1, 2):
        g, row, _ = words.ngrams(h, counts, n)
        found.append((row, g))
    text = np.repeat(np.arange(len(counts)), counts)
    same = np.zeros(len(h), dtype=np.uint64)
    for back in (1, 2, 3):
        equal = (h[back:] == h[:-back]) & (text[back:] == text[:-back])
        same[back:] |= equal.astype(np.uint64) << np.uint64(back)
    follow = np.zeros(len(h), dtype=np.uint64)
    follow[:-1] = np.where(text[1:] == text[:-1], same[1:], 0) if len(h) else 0
    found.append((text, words.mix(same | follow << np.uint64(8) | np.uint64(1 << 40))))
    size = np.diff(offsets)
    data = data[offsets[0]:offsets[-1]]
    at = np.repeat(np.arange(len(size)), size)
    c = _CLASS[data]
    if len(c) > 3:
        gram = c[:-3] << np.uint64(12) | c[1:-2] << np.uint64(8) | c[2:-1] << np.uint64(4) | c[3:]
        inside = at[:-3] == at[3:]
        seen = np.unique(at[:-3][inside].astype(np.uint64) << np.uint64(16) | gram[inside])
        found.append(((seen >> np.uint64(16)).astype(np.int64), words.mix((seen & np.uint64(0xFFFF)) | np.uint64(1 << 41))))
    row = np.concatenate([x[0] for x in found]).astype(np.uint64)
    value = np.concatenate([x[1] for x in found]) >> np.uint64(64 - BITS)
    both = np.unique(row << np.uint64(BITS) | value)
    return (both >> np.uint64(BITS)).astype(np.int64), (both & np.uint64((1 << BITS) - 1)).astype(np.int64)


def _sampled(batches):
    """(label, indicators as bytes) of labelled texts."""
    for batch in batches:
        labels = batch.column(1)
        for lo, hi, data, offsets in words.slices(batch.column(0), words.STEP):
            row, value = indicators(data, offsets)
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays(
                [labels.slice(lo, hi - lo).cast(pa.int32()), pa.array([value[a:b].astype(np.uint32).tobytes() for a, b in zip(edge, edge[1:])], pa.binary())],
                names=["label", "indicators"])


def log_ratio(features: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log of the ratio of an indicator's smoothed shares of the two classes."""
    share = []
    for side in (1, 0):
        count = np.full(1 << BITS, SMOOTHING)
        for i in np.flatnonzero(y == side):
            count[features[i]] += 1
        share.append(count / count.sum())
    return np.log(share[0] / share[1])


def dual_descent(features: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge support vector machine in its dual."""
    sign = np.where(y == 1, 1.0, -1.0)
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(y))
    values = [v / max(np.sqrt((v * v).sum()), 1e-12) for v in (ratio[f] for f in features)]
    norm = np.array([(v * v).sum() + 1.0 for v in values])
    share = {1.0: 0.5 * len(y) / max((sign > 0).sum(), 1), -1.0: 0.5 * len(y) / max((sign < 0).sum(), 1)}
    cost = np.array([COST * share[s] for s in sign])
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(y)):
            f, v = features[i], values[i]
            gradient = sign[i] * (weights[f] @ v + bias) - 1 + alpha[i] / (2 * cost[i])
            new = max(0.0, alpha[i] - gradient / (norm[i] + 1 / (2 * cost[i])))
            step = (new - alpha[i]) * sign[i]
            if step:
                weights[f] += step * v
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def margins(features: list[np.ndarray], ratio: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    def one(f):
        v = ratio[f]
        return float(weights[f] @ v / max(np.sqrt((v * v).sum()), 1e-12)) + bias

    return np.array([one(f) for f in features])


def sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of margins, by Newton steps on smoothed targets."""
    up, down = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - target) * m).sum(), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        hess = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)


def _fit(batches):
    """One row: the weights times ratios, the squared ratios' root, bias and sigmoid."""
    features, y = [], []
    for batch in batches:
        y += batch.column(0).to_pylist()
        features += [np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in batch.column(1).to_pylist()]
    y = np.array(y, dtype=np.int64)
    order = sorted(range(len(y)), key=lambda i: (features[i].tobytes(), y[i]))  # whatever order rows came in
    features, y = [features[i] for i in order], y[np.array(order, dtype=np.int64)]
    if len(np.unique(y)) < 2:
        ratio, weights, bias, curve = np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, (1.0, 0.0 if not len(y) else (4.0 if y[0] == 1 else -4.0))
    else:
        fold, held = np.arange(len(y)) % 4, np.zeros(len(y))
        if len(y) >= 40 and min((y == c).sum() for c in (0, 1)) >= 8:
            for k in range(4):
                own = [features[i] for i in np.flatnonzero(fold != k)]
                r = log_ratio(own, y[fold != k])
                held[fold == k] = margins([features[i] for i in np.flatnonzero(fold == k)], r, *dual_descent(own, y[fold != k], r))
            curve = sigmoid_fit(held, y)
        else:
            curve = (2.0, 0.0)
        ratio = log_ratio(features, y)
        weights, bias = dual_descent(features, y, ratio)
    model = np.stack([weights * ratio, ratio * ratio]).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary()), pa.array([bias]), pa.array([curve[0]]), pa.array([float(curve[1])])],
                                     names=["model", "bias", "slope", "shift"])


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE):
    """The model of at most ``sample`` labelled rows (labels 0 and 1; others are left out)."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).mapInArrow(
        _sampled, "label int, indicators binary")
    model = rows.repartition(1).mapInArrow(_fit, "model binary, bias double, slope double, shift double").first()
    return model if model else (np.zeros((2, 1 << BITS), np.float32).tobytes(), 0.0, 1.0, 0.0)


def chosen_labels(labels: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` rows with a label of 0 or 1, those with the smallest hash of their id."""
    return (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, label_col)
            .orderBy(F.xxhash64(id_col), id_col, label_col).limit(sample))


def score(docs: DataFrame, model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``: the score of every whole text."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.drop(score_col) if score_col != text_col else docs
    out = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])
    arrow, at = to_arrow_schema(out), docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))

    def run(batches):
        blob, bias, slope, shift = held.value
        scaled, squares = np.frombuffer(blob, dtype=np.float32).reshape(2, -1).astype(np.float64)
        for batch in batches:
            got = []
            for lo, hi, data, offsets in words.slices(batch.column(at), words.STEP):
                row, value = indicators(data, offsets)
                top = np.bincount(row, scaled[value], minlength=hi - lo)
                size = np.sqrt(np.bincount(row, squares[value], minlength=hi - lo))
                m = top / np.maximum(size, 1e-12) + bias
                got.append(1 / (1 + np.exp(-np.clip(slope * m + shift, -500, 500))))
            columns = [*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return docs.mapInArrow(run, out)


def held_out(id_col: str) -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """The model of ``labels.quality``, learnt without the held-out rows."""
    chosen = chosen_labels(labels.where(~held_out("doc_id")), "doc_id", "quality", sample)
    chosen = shared.staged(chosen, "labels")  # at most ``sample`` rows, so it may be broadcast
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "text", "quality", sample)


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = score(docs, quality_model(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
