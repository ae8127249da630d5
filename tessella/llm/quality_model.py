"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are its distinct words, hashed to ``BUCKETS`` ids, statistics
of its structure (length, shares of capitals, digits, symbols and marks, word
length, repeated lines and words) and metadata columns that the caller names
(numbers, on a logarithmic scale), each cut into bins. A second order
factorisation machine scores all pairs of them in linear time, by
``0.5 * sum_f((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.

It is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest
hash of their id (a documented bound: the sample, and what the driver holds, do
not grow with the corpus). The model has a fixed size, so it is broadcast.
Scoring is a map over the scan without any shuffle.

Edge cases: null text counts as empty; an empty text has only structure and
metadata and is scored from those. A very long text is read whole. Metadata that
is null, negative or not finite has a bin of its own. A labelled id with several
rows is learnt from one of them, that of the smallest text hash; among ties in the
id hash the smaller id is learnt from. Labels without a matching document, null labels and null ids
are not used. Without usable labels every score is 0.5; with one class only it
is near that class. Repeated rows get equal scores. Extra columns are carried
through, one named like the result is replaced. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import bytehash
from tessella.llm.common import portable

BUCKETS = 1 << 16
FACTORS = 8
BINS = 16
TRAIN_ROWS = 12_000
EPOCHS = 8
BATCH = 512
RATE = 0.05
DECAY = 1e-5
SEED = 11

#: Byte classes whose share of a text is a feature.
CLASSES = {
    "capital": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "mark": b"!?",
    "stop": b".,;:",
    "beyond_ascii": range(128, 256),
    "line": b"\n",
}
STATS = [*CLASSES, "log_bytes", "log_words", "word_length", "repeated_lines", "repeated_words"]
#: Bins of a metadata column: one for no value, the others by its logarithm.
META_BINS = 32
#: Metadata columns that a model has room for.
META = 4
WIDTH = BUCKETS + len(STATS) * BINS + META * META_BINS


def _shares(b: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    size = np.maximum(np.diff(offsets), 1)
    out = []
    for members in CLASSES.values():
        table = np.zeros(256, bool)
        table[list(members)] = True
        seen = np.r_[0, np.cumsum(table[b])]
        out.append((seen[offsets[1:]] - seen[offsets[:-1]]) / size)
    return out


def _distinct(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, value) pairs and their number for each document."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    keep = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])] if len(d) else np.zeros(0, bool)
    return d[keep], v[keep], np.bincount(d[keep], minlength=n)


def meta_bins(column: pa.Array) -> np.ndarray:
    """Bins of a metadata column: half powers of two, and 0 where there is no value."""
    x = column.cast(pa.float64()).fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.isfinite(x) & (x >= 0)
    return np.where(good, 1 + np.minimum(np.log2(np.where(good, x, 0) + 1) * 1.5, META_BINS - 2), 0).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray, meta: list[np.ndarray] = []) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, past last, text, feature, value) for runs of texts."""
    for i, j, b, at in bytehash.chunks(data, offsets):
        n = j - i
        h, doc = bytehash.word_hashes(bytehash.LOWER[b], at)
        words = np.bincount(doc, minlength=n)
        d, f, count = _distinct(doc, (h & np.uint64(BUCKETS - 1)).astype(np.int64), n)
        breaks = b == 10
        edge = np.zeros(len(b) + 1, bool)
        edge[at] = True
        starts = np.flatnonzero((np.r_[True, breaks[:-1]] | edge[:-1]) & ~breaks) if len(b) else np.zeros(0, np.int64)
        ends = np.flatnonzero((np.r_[breaks[1:], True] | edge[1:]) & ~breaks) + 1 if len(b) else np.zeros(0, np.int64)
        line_doc = np.searchsorted(at, starts, side="right") - 1
        lines = np.bincount(line_doc, minlength=n)
        _, _, line_count = _distinct(line_doc, bytehash.span_hash(bytehash.prefix(b), starts, ends).view(np.int64), n)
        size = np.diff(at)
        stats = _shares(b, at)
        scaled = [np.sqrt(s) for s in stats]  # small shares matter most
        scaled += [np.log1p(size) / 14, np.log1p(words) / 12, np.minimum(size / np.maximum(words, 1), 24) / 24]
        scaled += [1 - line_count / np.maximum(lines, 1), 1 - count / np.maximum(words, 1)]
        bins = [np.clip((s * BINS).astype(np.int64), 0, BINS - 1) + BUCKETS + k * BINS for k, s in enumerate(scaled)]
        bins += [m[i:j] + BUCKETS + len(STATS) * BINS + k * META_BINS for k, m in enumerate(meta)]
        text = np.concatenate([d, *[np.arange(n)] * len(bins)])
        feature = np.concatenate([f, *bins])
        value = np.concatenate([1 / np.sqrt(count[d]), np.full(n * len(bins), 0.5)])
        yield i, j, text, feature, value


class Machine:
    """The model: bias, linear weights and factors."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(WIDTH)
        self.v = rng.normal(0, 0.05, (WIDTH, FACTORS))

    def _parts(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(text, weights=self.v[feature, f] * value, minlength=n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(text, weights=(self.v**2).sum(axis=1)[feature] * value**2, minlength=n)
        linear = np.bincount(text, weights=self.w[feature] * value, minlength=n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Probability that a text is good."""
        z, _ = self._parts(text, feature, value, n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = SEED) -> Machine:
        """Adam over small batches; the order of rows is fixed by the seed."""
        if not len(rows):
            return self
        share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(share / (1 - share)))
        if labels.min() == labels.max():
            return self
        rng = np.random.default_rng(seed)
        moments = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)]
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                pick = order[at : at + BATCH]
                feature = np.concatenate([rows[i][0] for i in pick])
                value = np.concatenate([rows[i][1] for i in pick])
                text = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                z, sums = self._parts(text, feature, value, len(pick))
                miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
                step += 1
                rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                self.bias -= RATE * miss.sum()
                pull = miss[text] * value
                gw = np.bincount(feature, weights=pull, minlength=WIDTH) + DECAY * self.w
                own = np.bincount(feature, weights=pull * value, minlength=WIDTH)
                gv = np.stack([np.bincount(feature, weights=pull * sums[text, f], minlength=WIDTH) for f in range(FACTORS)], axis=1)
                gv += DECAY * self.v - self.v * own[:, None]
                for x, g, m, s in ((self.w, gw, *moments[:2]), (self.v, gv, *moments[2:])):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    x -= rate * m / (np.sqrt(s) + 1e-8)
        return self


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = bytehash.text_bytes(batch.column("text"))
        meta = [meta_bins(c) for c in batch.column("meta").flatten()] if "meta" in batch.schema.names else []
        for i, j, text, feature, value in features(data, offsets, meta):
            order = np.argsort(text, kind="stable")
            at = np.r_[0, np.cumsum(np.bincount(text, minlength=j - i))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x[order])) for x in (feature.astype(np.int32), value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), *lists], names=["doc_id", "label", "feature", "value"])


def _meta(metadata: Sequence[str]) -> list[Column]:
    if len(metadata) > META:
        raise ValueError(f"at most {META} metadata columns")
    return [F.struct(*[F.col(f"`{c}`").cast("double").alias(f"m{k}") for k, c in enumerate(metadata)]).alias("meta")] if metadata else []


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", metadata: Sequence[str] = (), train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on ``labels`` (doc_id, label 0 or 1): the rows with the smallest id hashes."""
    usable = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    picked = usable.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(train_rows).withColumnRenamed("doc_id", "l_id")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_meta(metadata))
    joined = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))  # at most train_rows rows
    # one row an id, however often a table repeats it, so the sample's bound holds for what the driver gets
    given = ["text", *(["meta"] if metadata else [])]
    one = joined.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), *given)).alias("r")).select("doc_id", "label", *[f"r.{c}" for c in given])
    table = one.mapInArrow(_rows, "doc_id long, label int, feature array<int>, value array<float>").toArrow().sort_by("doc_id")
    y = table.column("label").to_numpy().astype(float)
    rows = []
    for f, v in zip(table.column("feature").chunks, table.column("value").chunks, strict=True):
        rows += [(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(f, v, strict=True)]
    return Machine().fit(rows, y)


def score(docs: DataFrame, model: Machine, *, text: str = "text", metadata: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``score``, the probability of a good text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w, model.v))
    n = len(metadata)

    @F.arrow_udf("double")
    def run(texts: pa.Array, *meta: pa.Array) -> pa.Array:
        machine = Machine()
        machine.bias, machine.w, machine.v = shared.value
        data, offsets = bytehash.text_bytes(texts)
        out = np.zeros(len(texts))
        for i, j, t, f, v in features(data, offsets, [meta_bins(m) for m in meta[:n]]):
            out[i:j] = machine.score(t, f, v, j - i)
        return pa.array(out)

    return docs.withColumn("score", run(F.col(text), *[F.col(f"`{c}`").cast("double") for c in metadata]))


portable(__name__)
