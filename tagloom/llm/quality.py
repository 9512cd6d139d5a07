"""Document quality by naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, and a linear hinge-loss model fitted by dual coordinate descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from tagloom import ship
from tagloom.llm.common import FOLD, SPACE, mix, prefix_sums, runs, span_hash, text_chunks

#: Classes of bytes for word shapes: letters by case, digits, bytes of longer characters; others stand for themselves.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 97


#: Words that stand again after so many words, and the shares of all words from which that is a feature.
_LAGS, _SHARES = (1, 2, 3, 4), np.array([0.02, 0.05, 0.1, 0.2, 0.4, 0.7])


def _echoes(word: np.ndarray, row: np.ndarray, at: np.ndarray, bits: int) -> list[np.ndarray]:
    """Feature numbers of each row for n-grams that begin and end with one word, by the shares they reach."""
    size = np.maximum(np.diff(at), 1)
    reached = np.zeros((len(size), len(_LAGS), len(_SHARES)), bool)
    for i, k in enumerate(_LAGS):
        again = (word[k:] == word[:-k]) & (row[k:] == row[:-k])
        share = np.bincount(row[k:][again], minlength=len(size)) / size
        reached[:, i, :] = share[:, None] >= _SHARES
    number = (mix(np.arange(1, len(_LAGS) * len(_SHARES) + 1, dtype=np.uint64) << np.uint64(40)) >> np.uint64(64 - bits)).astype(np.int32)
    return [number[r] for r in reached.reshape(len(size), -1)]


def features(codes: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Distinct feature numbers of each row: words, word pairs, shapes of word ends, pairs of those, and words said again."""
    start, end, row = runs(~SPACE[codes], offsets)
    at = np.searchsorted(row, np.arange(len(offsets)))
    shift, n = np.uint64(64 - bits), len(start)
    if n:
        word = span_hash(prefix_sums(FOLD[codes]), start, end)
        tail = span_hash(prefix_sums(_SHAPE[codes]), np.maximum(start, end - 3), end)
        kinds = [word, tail * np.uint64(0xD1B54A32D192ED03)]
        pair = [np.append(mix(k[:-1] * np.uint64(0x9E3779B97F4A7C15) + k[1:]), k[-1:]) for k in kinds]
        echoes = _echoes(word, row, at, bits)
        kinds = [(mix(k + np.uint64(i)) >> shift).astype(np.int32) for i, k in enumerate((*kinds, *pair))]
    for k, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if lo == hi:
            yield np.zeros(0, np.int32)
            continue
        f = np.sort(np.concatenate((kinds[0][lo:hi], kinds[1][lo:hi], kinds[2][lo : hi - 1], kinds[3][lo : hi - 1], echoes[k])))
        yield f[np.concatenate(([True], f[1:] != f[:-1]))]


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    bits: int
    scale: float = 4.0

    def score(self, f: np.ndarray) -> float:
        margin = self.bias + (float(self.weight[f].sum()) / np.sqrt(len(f)) if len(f) else 0.0)
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.scale * margin, -60, 60))))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, c: float = 1.0, epochs: int = 12) -> Model:
    """Fits on feature lists and labels 0/1. With no rows every score is 0.5; with one class, all scores lean to it."""
    weight = np.zeros(1 << bits)
    if not len(rows):
        return Model(weight, 0.0, bits)
    if labels.min() == labels.max():
        return Model(weight, 1.0 if labels[0] else -1.0, bits)
    count = np.ones((2, 1 << bits))
    for f, y in zip(rows, labels, strict=True):
        count[int(y), f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    y = np.where(labels > 0, 1.0, -1.0)
    value = [ratio[f] / np.sqrt(max(1, len(f))) for f in rows]
    square = np.array([float(v @ v) + 1.0 for v in value])
    alpha, bias, order = np.zeros(len(rows)), 0.0, np.random.default_rng(3)
    upper = c * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (float(weight[rows[i]] @ value[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weight[rows[i]] += step * y[i] * value[i]
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return Model(weight * ratio, bias, bits)


def fit_frame(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_fit_rows: int = 6000, bits: int = 18, max_fit_features: int = 40_000_000) -> Model:
    """Fits on at most max_fit_rows labelled documents whose crc32(id as text) mod 3 is not 1: those with the least hash of the id.

    Of those, in the order of the hash, the ones whose features add up to max_fit_features are used. Both bounds keep the one
    task that fits the same at every size, whatever the texts' length. Of an id with several labels the least counts;
    labels other than 0 and 1 and null ids are not used.
    """
    ship(docs.sparkSession)
    key = F.col(id_col).cast("bigint")
    marked = labels.select(key.alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1) and crc32(cast(id as string)) % 3 <> 1")
    chosen = marked.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_fit_rows)
    got = docs.select(key.alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")  # max_fit_rows bounds it
    rows = got.mapInArrow(_collected(bits), "id bigint, y int, f array<int>")
    upto = F.sum(F.size("f")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= max_fit_features).select("id", "y", "f")  # one task: max_fit_rows at most
    found = rows.mapInArrow(_fitted(bits), "weight binary, bias double").first()
    return Model(np.frombuffer(found["weight"], np.float32), found["bias"], bits) if found else fit([], np.zeros(0), bits)


def _fitted(bits: int):
    """Fits in one task, so that neither rows nor features come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, lists = [], [], []
        for batch in batches:
            column = batch.column("f")
            ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
            lists += [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            ids.append(batch.column("id").to_numpy())
            labels.append(batch.column("y").to_numpy())
        order = np.lexsort((np.array([len(f) for f in lists]), np.concatenate(ids))) if ids else []
        model = fit([lists[i] for i in order], np.concatenate(labels)[order] if ids else np.zeros(0), bits)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    return run


def _collected(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, codes, offsets in text_chunks(batch.column("text")):
                f = list(features(codes, offsets, bits))
                ends = np.cumsum([0, *map(len, f)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), batch.column("y").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(f)))], names=["id", "y", "f"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """All columns of docs besides score (0 to 1) and predicted (1 from 0.5 up) of each whole text; null text is empty.

    Columns of docs that have these two names are replaced. Rows stand alone: one that repeats gets the same score. Texts
    of any length are read whole, an empty one has the model's bias as its score.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weight.astype(np.float32), model.bias, model.scale))  # 2**bits floats
    bits, names, fields = model.bits, docs.columns, docs.schema.fields
    at, new = names.index(text_col), (score_col, predicted_col)
    kept = [i for i, n in enumerate(names) if n.lower() not in {c.lower() for c in new}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, scale = shared.value
        own = Model(weight, bias, bits, scale)
        for batch in batches:
            for lo, hi, codes, offsets in text_chunks(batch.column(at)):
                s = np.array([own.score(f) for f in features(codes, offsets, bits)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*(names[i] for i in kept), *new])

    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # a name with a dot would be taken for a field
    return plain.mapInArrow(run, StructType([fields[i] for i in kept]).add(score_col, DoubleType()).add(predicted_col, IntegerType()))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_fit_rows: int = 6000, **names) -> DataFrame:
    """Scores every row of docs by a model fitted on its labelled rows; see fit_frame() and score()."""
    return score(docs, fit_frame(docs, labels, id_col, text_col, max_fit_rows=max_fit_rows), id_col, text_col, **names)
