"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import frugal, slices, table
from lorebase.llm.labelled import remainder, sample
from lorebase.workers import ship

#: Buckets of hashed words, bins of a statistic, and rank of the interactions.
BUCKETS, BINS, RANK = 1 << 14, 12, 8
#: Statistics in [0, 1], each one-hot by bin.
STATISTICS = ("upper", "digits", "signs", "spaces", "controls", "length", "words", "word_length", "distinct_words", "distinct_lines", "common_line", "ends_marked", "lone_signs", "short_lines", "metadata_length")
WIDTH = BUCKETS + BINS * len(STATISTICS)
_UPPER = np.array([65 <= b <= 90 for b in range(256)], np.float64)
_DIGIT = np.array([48 <= b <= 57 for b in range(256)], np.float64)
_SIGN = np.array([33 <= b <= 47 or 58 <= b <= 64 or 91 <= b <= 96 or 123 <= b <= 126 for b in range(256)], np.float64)
MARKED = re.compile(r"[^\w\s]{2,}(?=\s|$)")


def statistics(text: str, n_chars: int | None) -> list[float]:
    """The values of STATISTICS for a whole text and its n_chars column (null: the text's own length)."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, tokens, lines = max(1, len(data)), text.split(), [x for x in text.split("\n") if x.strip()]
    distinct = Counter(lines)
    letters = max(1.0, float(counts[65:91].sum() + counts[97:123].sum()))
    squeeze = lambda x, most: min(1.0, math.log1p(x) / math.log1p(most))
    return [
        float(counts @ _UPPER) / letters, float(counts @ _DIGIT) / n, min(1.0, 3.0 * float(counts @ _SIGN) / n), min(1.0, 3.0 * float(counts[32]) / n), min(1.0, 10.0 * float(counts[:32].sum()) / n),
        squeeze(n, 200_000), squeeze(len(tokens), 40_000), min(1.0, n / max(1, len(tokens)) / 20), len(set(tokens)) / max(1, len(tokens)), len(distinct) / max(1, len(lines)),
        max(distinct.values(), default=0) / max(1, len(lines)), len(MARKED.findall(text)) / max(1, len(tokens)), tokens.count("|") / max(1, len(tokens)), sum(len(x) < 40 for x in lines) / max(1, len(lines)), squeeze(len(text) if n_chars is None else max(0, n_chars), 200_000),
    ]


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: distinct words, each 1/sqrt(their number), and the bin of every statistic with value 1/2."""
    text = text or ""
    words = {zlib.crc32(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for w in set(text.lower().split())}
    stats = statistics(text, n_chars)
    index = np.fromiter(sorted(words), np.int32, len(words))
    bins = np.array([BUCKETS + i * BINS + min(BINS - 1, int(max(0.0, x) * BINS)) for i, x in enumerate(stats)], np.int32)
    return np.r_[index, bins], values_of(np.array([len(index) + len(bins)]))


def values_of(sizes: np.ndarray) -> np.ndarray:
    """The values of rows with so many features each: all but the last of a row are words."""
    words = sizes - len(STATISTICS)
    each = np.stack([1.0 / np.sqrt(np.maximum(1, words)), np.full(len(sizes), 0.5)], axis=1).ravel()
    return np.repeat(each, np.stack([words, np.full(len(sizes), len(STATISTICS))], axis=1).ravel()).astype(np.float32)


class Machine:
    """score = bias + sum(w x) + 1/2 sum over factors of (sum(v x)^2 - sum(v^2 x^2)), through a logistic."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(WIDTH, np.float32)
        self.slope, self.shift = 1.0, 0.0
        self.v = rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)

    def raws(self, index: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic of rows with ``sizes`` features each, and the factors of features and rows."""
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        vx = self.v[index] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = np.square(sums).sum(axis=1) - np.add.reduceat(np.square(vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.w[index] * values, starts) + 0.5 * pairs, vx, sums

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores in 0 to 1 of rows given as their features' indices."""
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(x) for x in rows])
        raw = self.raws(np.concatenate(rows), values_of(sizes), sizes)[0].astype(np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.shift, -30.0, 30.0)))

    def calibrate(self, rows: list[np.ndarray], y: np.ndarray, cut: float) -> Machine:
        """Turn scores so that ``cut`` parts rows that were not fitted best, as the mean of both classes' accuracies goes.

        Of equally good places the middle is taken. Slope 1 is kept: order and distances of raw scores stay. Without both classes nothing changes.
        """
        good = y > 0
        if not good.any() or good.all():
            return self
        sizes = np.array([len(x) for x in rows])
        raw = self.raws(np.concatenate(rows), values_of(sizes), sizes)[0].astype(np.float64)
        places = np.unique(raw)
        places = (places[1:] + places[:-1]) / 2
        if len(places):
            balanced = np.array([(raw[good] >= t).mean() + (raw[~good] < t).mean() for t in places])
            best = np.flatnonzero(balanced >= balanced.max() - 1e-9)
            self.shift = math.log(cut / (1 - cut)) - float(places[best[len(best) // 2]])
        return self

    def fit(self, rows: list[np.ndarray], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 2e-4, seed: int = 3) -> Machine:
        """AdaGrad over shuffled batches; gradients of a batch are summed by index."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(WIDTH, 1e-2, np.float32), np.full((WIDTH, RANK), 1e-2, np.float32), 1e-2
        p = float(np.clip(y.mean(), 0.01, 0.99))
        self.bias = math.log(p / (1 - p))
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                index, sizes = np.concatenate([rows[i] for i in chosen]), np.array([len(rows[i]) for i in chosen])
                values = values_of(sizes)
                raw, vx, sums = self.raws(index, values, sizes)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[chosen]).astype(np.float32)
                each = np.repeat(error, sizes) * values
                dv = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                found, where = np.unique(index, return_inverse=True)
                w = np.bincount(where, each, len(found)).astype(np.float32) / len(chosen) + decay * self.w[found]
                v = np.stack([np.bincount(where, dv[:, f], len(found)) for f in range(RANK)], axis=1).astype(np.float32) / len(chosen) + decay * self.v[found]
                gw[found] += w * w
                gv[found] += v * v
                self.w[found] -= rate * w / np.sqrt(gw[found])
                self.v[found] -= 0.3 * rate * v / np.sqrt(gv[found])
                b = float(error.mean())
                gb += b * b
                self.bias -= rate * b / math.sqrt(gb)
        return self


FOLDS = 3


def _cross_fitted(rows: list[np.ndarray], y: np.ndarray, ids: list[str], cut: float) -> float:
    """The shift that parts rows best when each is scored by a machine that has not seen it."""
    fold = np.array([zlib.crc32(f"fold {i}".encode()) % FOLDS for i in ids])
    shifts = []
    for k in range(FOLDS):
        rest, mine = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if 0 < y[rest].sum() < len(rest) and 0 < y[mine].sum() < len(mine):
            shifts.append(Machine().fit([rows[i] for i in rest], y[rest]).calibrate([rows[i] for i in mine], y[mine], cut).shift)
    return float(np.median(shifts)) if shifts else 0.0


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = (3_000, 6_000), of: int = 4, held: int = 2, most_features: int = 8_000_000, cut: float = 0.7) -> Machine:
    """Fit on about ``most`` labelled rows of quality 0 and 1 at most (remainder ``held`` of the id never).

    Each third of the sample, dealt by a hash of the id, is scored by a machine that was fitted on the others; these scores set the
    calibration of the machine fitted on all, so that ``cut`` is where the two classes part.

    Features of the sample are computed on the executors and written; what comes to the driver is their indices, 4 bytes
    each and about ``most_features`` at most: a sample of very long texts is thinned by a hash of the id. Without both
    classes the score is constant.
    """
    ship(docs.sparkSession)
    rows, _ = sample(docs.select("doc_id", "text", "n_chars"), labels, "quality", of, held, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [features(t, n)[0] for t, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "index"])

    data = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("n_chars").cast("long"), "y").mapInArrow(frugal(run), "doc_id string, y int, index array<int>")
    data = table(data, "quality-sample")
    total, parts = data.agg(F.sum(F.size("index"))).first()[0] or 0, 1 << 20
    if total > most_features:
        data = data.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(parts)) < int(most_features / total * parts))
    data = data.toArrow().sort_by("doc_id")
    y = data["y"].to_numpy().astype(np.float32)
    machine = Machine()
    if len(y) and 0 < y.sum() < len(y):
        lists = data["index"].combine_chunks()
        index, edges = lists.flatten().to_numpy().astype(np.int32), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
        rows = [index[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        machine.fit(rows, y)
        machine.shift = _cross_fitted(rows, y, data["doc_id"].to_pylist(), cut)
    elif len(y):
        machine.v[:] = 0
        machine.bias = 3.0 if y[0] else -3.0
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, labels: DataFrame, of: int = 4, held: int = 2, threshold: float = 0.7, most: tuple[int, int] = (3_000, 6_000), id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Null texts count as empty and are scored like any; a null n_chars counts as the text's length; a null id
    is not held out; repeated rows are scored alike; an empty table gives no rows; without labels every score
    is 0.5; other columns are left out.
    """
    chars = F.col(chars_col).cast("long") if chars_col and chars_col in docs.columns else F.lit(None).cast("long")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), chars.alias("n_chars"))
    shared = docs.sparkSession.sparkContext.broadcast(train(slim, labels, most, of, held, cut=threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in slices(batches, 2):
            scores = machine.scores([features(t, n)[0] for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = slim.select("doc_id", (remainder(F.col("doc_id"), of) == held).alias("held_out"), "text", "n_chars")
    out = rows.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
