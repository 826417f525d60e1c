"""Quality classifier: naive Bayes scaled n-grams under a linear hinge-loss model.

Indicators of word 1- and 2-grams and byte 3-grams are hashed into one space,
multiplied by the log-count ratio of the two classes, length-normalised, and
weighed by a support vector model fitted by dual coordinate descent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, slices, text_docs, to_batch
from .kernels import LOWER, join_texts, mix, prefix, span_hash, words

#: Bytes of text whose features are worked at a time: some 100 bytes of memory for each.
SLICE = 1 << 20
#: Hashed features (bits) and the most labelled rows that the linear model is fitted on.
BITS = 18
SAMPLE = 6_000


def features(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature), each pair once, by text: the n-grams that occur in each text."""
    buf, offs = join_texts(texts, b"\n")
    shift, d = np.uint64(64 - bits), []
    if len(buf) > 3:
        b = buf.astype(np.uint32)
        tri = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
        doc_of = np.repeat(np.arange(len(texts), dtype=np.uint32), np.diff(offs))[:-2]
        inner = np.ones(len(tri), dtype=bool)
        ends = offs[1:] - 1  # no gram takes in a separator
        for back in range(3):
            at = ends - back
            inner[at[(at >= 0) & (at < len(tri))]] = False
        d.append(doc_of[inner].astype(np.uint64) << np.uint64(bits) | (tri[inner] * np.uint64(0x9E3779B97F4A7C15)) >> shift)
    s, e, doc = words(buf, offs)
    h = span_hash(prefix(LOWER[buf]), s, e)
    doc = doc.astype(np.uint64)
    d.append(doc << np.uint64(bits) | h >> shift)
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        pair = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:])
        d.append((doc[1:] << np.uint64(bits) | pair >> shift)[same])
    keys = np.sort(np.concatenate(d))
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float = 1.0, epochs: int = 20, seed: int = 0) -> np.ndarray:
    """Weights (the last one the bias) that minimise |w|^2/2 + c * sum of hinge losses.

    One dual variable at a time is moved to its optimum within [0, c]; passes are in
    random order and end when no projected gradient is large. rows: (features, values).
    """
    w, alpha = np.zeros(dim + 1), np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            g = y[i] * (w[at] @ v + w[dim]) - 1.0
            pg = min(g, 0.0) if alpha[i] == 0 else max(g, 0.0) if alpha[i] == c else g
            worst = max(worst, abs(pg))
            if pg:
                old = alpha[i]
                alpha[i] = min(max(old - g / norm[i], 0.0), c)
                step = (alpha[i] - old) * y[i]
                w[at] += step * v
                w[dim] += step
        if worst < 0.01:
            break
    return w


def fit_sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, offset) of the logistic curve through margins, with smoothed targets."""
    pos = y > 0
    t = np.where(pos, (pos.sum() + 1) / (pos.sum() + 2), 1 / ((~pos).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


class Model:
    """Log-count ratios, weights and the calibration curve; about 3 MB whatever the corpus."""

    def __init__(self, ratio: np.ndarray, weights: np.ndarray, slope: float, offset: float, bits: int):
        self.ratio, self.bits, self.slope, self.offset = ratio, bits, slope, offset
        self.product, self.bias = (ratio * weights[:-1]).astype(np.float64), float(weights[-1])

    def margins(self, texts: list[bytes]) -> np.ndarray:
        doc, f = features(texts, self.bits)
        n = len(texts)
        square = np.bincount(doc, self.ratio[f] ** 2, n)
        return np.bincount(doc, self.product[f], n) / np.sqrt(np.maximum(square, 1e-12)) + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def held_out(col, folds: int, fold: int):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; false for null ids."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents that are not held out (crc32(doc_id) mod 3 is not 1).

    The class counts of all features cover every such document. The linear model takes
    at most ``sample`` of them, by hash of doc_id (the documented bound). A document
    labelled more than once has its largest label; null labels do not count. With fewer
    than two classes the model scores the smoothed share of label 1 everywhere.
    """
    dim = 1 << bits
    lab = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out("doc_id", 3, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    packed = pa.schema([("doc_id", pa.int64()), ("z", pa.binary())])

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in slices(batches):
            yield to_batch({"doc_id": b.column(0), "z": [z.compress(t) for t in column_bytes(b, "text")]}, packed)

    small = text_docs(docs).filter(F.col("doc_id").isNotNull() & ~held_out("doc_id", 3, 1)).mapInArrow(squeeze, "doc_id long, z binary")
    joined = small.join(lab.hint("merge"), "doc_id").select("y", "z")  # one plan at every size
    counted = pa.schema([("f", pa.int32()), ("neg", pa.int64()), ("pos", pa.int64())])

    def count(batches):
        unzip, n = zstandard.ZstdDecompressor(), np.zeros((2, dim + 1), dtype=np.int64)
        for b in slices(batches, "z", SLICE // 4):
            y = b.column(0).to_numpy()
            doc, f = features([unzip.decompress(x) for x in b.column(1).to_pylist()], bits)
            n += np.stack([np.bincount(np.append(f[y[doc] == k], dim), minlength=dim + 1) for k in (0, 1)])
            n[:, dim] += np.array([(y == 0).sum(), (y == 1).sum()]) - 1
        at = np.flatnonzero(n.any(axis=0))
        yield to_batch({"f": at.astype(np.int32), "neg": n[0, at], "pos": n[1, at]}, counted)

    # At most one row for each hashed feature comes to the driver.
    table = joined.mapInArrow(count, "f int, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toPandas()
    n = np.zeros((2, dim + 1))
    n[0, table["f"]], n[1, table["f"]] = table["neg"], table["pos"]
    total = n[:, dim]
    if total.min() == 0:
        share = (total[1] + 1) / (total.sum() + 2)
        return Model(np.zeros(dim), np.zeros(dim + 1), 1.0, float(np.log(share / (1 - share))), bits)
    smooth = n[:, :dim] + 1.0
    logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    ratio = logs[1] - logs[0]

    few = F.broadcast(lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = text_docs(docs).join(few, "doc_id").select("doc_id", "y", "text")
    listed = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("f", pa.list_(pa.int32()))])

    def extract(batches):
        for b in slices(batches, max_bytes=SLICE):
            doc, f = features(column_bytes(b, "text"), bits)
            cuts = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(f.astype(np.int32)))], schema=listed)

    got = chosen.mapInArrow(extract, "doc_id long, y int, f array<int>").toArrow().to_pandas().sort_values("doc_id", kind="stable")
    y = got["y"].to_numpy() * 2.0 - 1.0
    rows = []
    for f in got["f"]:
        v = ratio[f]
        rows.append((f, v / np.sqrt(max(v @ v, 1e-12))))
    aside = np.arange(len(rows)) % 5 == 4
    if len({*y[~aside]}) < 2 or not aside.any():
        aside[:] = False
    w = dual_coordinate_descent([r for r, a in zip(rows, aside, strict=True) if not a], y[~aside], dim)
    check = aside if aside.any() else ~aside
    margin = np.array([w[f] @ v + w[dim] for (f, v), c in zip(rows, check, strict=True) if c])
    slope, offset = fit_sigmoid(margin, y[check])
    return Model(ratio, w, slope, offset, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, by its text alone; null text is empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def run(batches):
        for b in slices(batches, max_bytes=SLICE):
            yield to_batch({"doc_id": b.column(0), "held_out": b.column(2), "score": model.scores(column_bytes(b, "text"))}, schema)

    scored = text_docs(docs, held_out("doc_id", 3, 1).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores 0.5 or more."""

    def run(batches):
        for batch in batches:
            for b in slices([batch], max_bytes=SLICE):
                yield b.filter(pa.array(model.scores(column_bytes(b, "text")) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
