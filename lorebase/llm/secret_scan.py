"""Secret scans: rules find what is certain, a character convolutional network judges every other candidate in its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import frugal, n_partitions, slices
from lorebase.workers import ship, stored

KINDS = ("assign", "access", "hex")
#: The base rules. ASCII letters only are of either case.
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a longest stretch of hex digits under 24 matches nowhere inside
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: Candidates: stretches of the characters of keys that hold a digit or sign, or are long.
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{6,}")
MARK = re.compile(r"[0-9+/_=]")
LONG = 16
#: Characters of context that the network sees before and after a candidate.
BEFORE, AFTER = 24, 12
#: Codes: ASCII, one for all else; the same again inside the candidate. Filters, and characters that a filter spans.
CODES, FILTERS, SPAN = 129, 24, 5
#: Positions that are convolved at once.
PIECE = 1 << 16
#: Candidates and characters of a block, which one task fits, and of a step of the fit; passes over all blocks.
BLOCK_ROWS, BLOCK_CHARS, STEP_ROWS, STEP_CHARS, EPOCHS = 8_192, 8 << 20, 128, 1 << 20, 10
#: Parameters are summed in whole multiples of 2^-24, so their order does not matter. Outputs count as multiples of 1/512 up to 32.
UNIT, GRID, MOST_RAW = 1 << 24, 512, 32


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, start of the value) of the rules' findings, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Start and end of every candidate of a whole text, dots and dashes at the ends left out."""
    out = []
    for m in TOKEN.finditer(text):
        token = m[0]
        if len(token) < LONG and not MARK.search(token):
            continue
        start = m.start() + len(token) - len(token.lstrip(".-"))
        end = m.end() - (len(token) - len(token.rstrip(".-")))
        if end - start >= LEAST_VALUE and (end - start >= LONG or MARK.search(text, start, end)):
            out.append((start, end))
    return out


def labels(found: list[tuple[int, int]], base: list[tuple[int, int, int, int]]) -> tuple[list[int], list[bool]]:
    """For each candidate the kinds, as bits, of the rules whose values it meets, and whether it touches any finding.

    Both lists go by start and are passed once; findings of different kinds may overlap.
    """
    bits, touched, first = [], [], 0
    for start, end in found:
        while first < len(base) and base[first][2] <= start:
            first += 1
        mine, hit, k = 0, False, first
        while k < len(base) and base[k][1] < end:
            kind, _, past, value = base[k]
            if past > start:
                hit = True
                mine |= (value < end) << kind
            k += 1
        bits.append(mine)
        touched.append(hit)
    return bits, touched


def encode(windows: list[str], inside: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows as one array of codes, with gaps as wide as a filter's reach, and their starts and lengths."""
    reach = "\0" * (SPAN // 2)
    points = np.frombuffer((reach + "".join(w + reach for w in windows)).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.minimum(points, CODES - 1).astype(np.int32)
    sizes = np.array([len(w) for w in windows], np.int64)
    starts = np.cumsum(sizes + len(reach)) - sizes
    a, b = (np.array(x, np.int64) for x in zip(*inside, strict=True))
    edges = np.zeros(len(codes) + 1, np.int32)
    np.add.at(edges, starts + a, 1)
    np.add.at(edges, starts + b, -1)
    return codes + CODES * np.cumsum(edges[:-1]).astype(np.int32), starts, sizes


@dataclass
class Network:
    """Convolution, the largest and the mean value of every filter, and one logistic output a kind with its calibration.

    The outputs count from ``threshold`` on, after ``scale`` and ``shift``; an infinite threshold switches a kind off.
    """

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    last: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(KINDS)))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS)))
    threshold: np.ndarray = field(default_factory=lambda: np.full(len(KINDS), np.inf))

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(0, 0.3, (SPAN, 2 * CODES, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.2, (2 * FILTERS, len(KINDS))).astype(np.float32), np.zeros(len(KINDS), np.float32))

    def convolve(self, codes: np.ndarray) -> np.ndarray:
        """Filters' values at all places that have a whole span of codes around them."""
        places = len(codes) - SPAN + 1
        out = np.repeat(self.bias[None], places, axis=0)
        for k in range(SPAN):
            out += self.filters[k][codes[k : k + places]]
        return out

    def pieces(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]]:
        """``PIECE`` places at a time: windows that have some, the first place, where those of each window start and end, filters' values."""
        half, ends = SPAN // 2, starts + sizes
        for a in range(0, len(codes), PIECE):
            b = min(a + PIECE, len(codes) - half)
            first, past = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b)
            if first >= past or b <= a:
                continue
            low, mine = max(a, half), slice(first, past)
            yield mine, low, np.maximum(starts[mine], low) - low, np.minimum(ends[mine], b) - low, self.convolve(codes[low - half : b + half])

    def pooled(self, pieces: Iterable[tuple[slice, int, np.ndarray, np.ndarray, np.ndarray]], sizes: np.ndarray) -> np.ndarray:
        """Features of windows of any length."""
        most, total = np.zeros((len(sizes), FILTERS), self.bias.dtype), np.zeros((len(sizes), FILTERS), np.float64)
        for mine, _, s, e, value in pieces:
            bounds = np.stack([s, e], axis=1).ravel()
            padded = np.concatenate([np.maximum(value, 0), np.zeros((1, FILTERS), value.dtype)])
            most[mine] = np.maximum(most[mine], np.maximum.reduceat(padded, bounds)[::2])
            total[mine] += np.add.reduceat(padded, bounds)[::2]
        return np.concatenate([most, (total / sizes[:, None]).astype(most.dtype)], axis=1)

    def raw(self, windows: list[str], inside: list[tuple[int, int]]) -> np.ndarray:
        """Outputs before calibration, a row for each window."""
        if not windows:
            return np.zeros((0, len(KINDS)))
        codes, starts, sizes = encode(windows, inside)
        return (self.pooled(self.pieces(codes, starts, sizes), sizes) @ self.dense + self.last).astype(np.float64)

    def steps(self, windows: list[str], inside: list[tuple[int, int]]) -> np.ndarray:
        """Outputs before calibration as whole numbers of steps of 1 / ``GRID``, which chances and thresholds go by."""
        return np.rint(np.clip(self.raw(windows, inside), -MOST_RAW, MOST_RAW) * GRID).astype(np.int32)

    def scores(self, windows: list[str], inside: list[tuple[int, int]]) -> np.ndarray:
        """Calibrated chances of each kind."""
        return _chance(self.steps(windows, inside) / GRID, self.scale, self.shift)

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.dense, self.last]

    def flat(self) -> np.ndarray:
        """All fitted parameters in one row, as ``filled`` takes them."""
        return np.concatenate([p.ravel() for p in self.parameters()])

    def filled(self, flat: np.ndarray) -> Network:
        cuts = np.cumsum([p.size for p in self.parameters()])[:-1]
        return replace(self, **{name: x.reshape(p.shape).astype(p.dtype) for name, p, x in zip(("filters", "bias", "dense", "last"), self.parameters(), np.split(flat, cuts), strict=True)})

    def fit(self, windows: list[str], inside: list[tuple[int, int]], y: np.ndarray, weight: np.ndarray, seed: int, rate: float = 0.01) -> Network:
        """A copy after one pass of Adam on weighted cross entropy; ``y`` and ``weight`` have a column for each kind."""
        own = self.filled(self.flat())
        params = own.parameters()
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        order = np.random.default_rng(seed).permutation(len(windows))
        for step, rows in enumerate(_portions(order, [len(windows[i]) for i in order]), 1):
            grads = own._gradients([windows[i] for i in rows], [inside[i] for i in rows], y[rows], weight[rows])
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
        return own

    def _gradients(self, windows: list[str], inside: list[tuple[int, int]], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        codes, starts, sizes = encode(windows, inside)
        kept = list(self.pieces(codes, starts, sizes)) if len(codes) <= PIECE else None
        features = self.pooled(kept or self.pieces(codes, starts, sizes), sizes)
        error = (1 / (1 + np.exp(-np.clip(features @ self.dense + self.last, -30, 30))) - y) * weight / len(sizes)
        back, most = error @ self.dense.T, features[:, :FILTERS]
        filters, bias = np.zeros_like(self.filters), np.zeros_like(self.bias)
        for mine, low, s, e, value in kept or self.pieces(codes, starts, sizes):
            n = e - s
            owner = np.repeat(np.arange(mine.start, mine.stop), n)
            place = np.arange(len(owner)) + np.repeat(s - (np.cumsum(n) - n), n)
            value = value[place]
            slope = ((value == most[owner]) * back[owner, :FILTERS] + back[owner, FILTERS:] / sizes[owner, None]) * (value > 0)
            for k in range(SPAN):
                seen = codes[place + low - SPAN // 2 + k]
                order = np.argsort(seen, kind="stable")
                kinds, firsts = np.unique(seen[order], return_index=True)
                filters[k][kinds] += np.add.reduceat(slope[order], firsts)
            bias += slope.sum(0)
        return [filters, bias, (features.T @ error).astype(self.dense.dtype), error.sum(0).astype(self.last.dtype)]

    def calibrate(self, kind: int, steps: np.ndarray, good: np.ndarray, other: np.ndarray, recall: float) -> None:
        """Logistic calibration and threshold of a kind from held-back candidates, counted for each output (ascending).

        Of the thresholds that find ``recall`` of the kind's candidates those of the best precision count; the middle between the
        lowest and the highest of them is taken. A kind that the held-back part lacks on either side is switched off.
        """
        if not good.any() or not other.any():
            return
        self.scale[kind], self.shift[kind] = _logistic(steps / GRID, good, other)
        hits, all_above = np.cumsum(good[::-1])[::-1], np.cumsum((good + other)[::-1])[::-1]
        able = hits >= recall * hits[0]
        precision = hits / all_above
        best = steps[able & (precision == precision[able].max())]
        # a quarter of a step below, so that no output is as high as the threshold
        self.threshold[kind] = _chance((best[[0, -1]] - 0.25) / GRID, self.scale[kind], self.shift[kind]).mean()


def _chance(raw: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(raw * scale + shift, -30, 30)))


def _portions(order: np.ndarray, sizes: list[int]) -> Iterator[np.ndarray]:
    """``order`` cut into steps of ``STEP_ROWS`` windows and ``STEP_CHARS`` characters at most, one window at least."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i - start == STEP_ROWS or (i > start and held + n > STEP_CHARS):
            yield order[start:i]
            start, held = i, 0
        held += n
    if len(sizes):
        yield order[start:]


def _logistic(x: np.ndarray, good: np.ndarray, other: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic regression over counted outputs, by damped Newton steps with smoothed targets."""
    n1, n0 = good.sum(), other.sum()
    count, target = good + other, (good * ((n1 + 1) / (n1 + 2)) + other / (n0 + 2)) / (good + other)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, w = count * (p - target), count * (p * (1 - p) + 1e-6)
        h = np.array([[(w * x * x).sum() + 1e-6, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        da, db = np.clip(np.linalg.solve(h, [(g * x).sum(), g.sum()]), -1, 1)
        a, b = a - da, b - db
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


SCANNED = "base array<int>, starts array<int>, ends array<int>, windows array<string>, bits array<int>, touched array<boolean>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rules' findings (kind, start, end in turn) and all candidates of every whole text, in one pass over the texts."""
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                base, found = base_spans(text), candidates(text)
                bits, touched = labels(found, base)
                windows = [text[max(0, a - BEFORE) : b + AFTER] for a, b in found]
                out.append(([x for s in base for x in s[:3]], [a for a, _ in found], [b for _, b in found], windows, bits, touched))
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (ints, ints, ints, pa.list_(pa.string()), ints, pa.list_(pa.bool_())), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "starts", "ends", "windows", "bits", "touched"])

    return slim.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {SCANNED}")


BLOCK = "part long, windows array<string>, before array<int>, size array<int>, bits array<int>"


def _blocks(rows: DataFrame, parts: int) -> DataFrame:
    """A row for each part of the candidates, drawn by a hash, with its windows in order."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([(c, "ascending") for c in ("window", "before", "size")])
        lists = [pa.array([group[c].to_pylist()], pa.list_(t)) for c, t in zip(("window", "before", "size", "bits"), (pa.string(), *[pa.int32()] * 3), strict=True)]
        return pa.Table.from_arrays([pa.array([group["part"][0].as_py()], pa.int64()), *lists], ["part", "windows", "before", "size", "bits"])

    part = F.pmod(F.xxhash64(F.lit(11), "window", "before", "size"), F.lit(parts)).alias("part")
    ints = [F.col(c).cast("int").alias(c) for c in ("before", "size", "bits")]
    dealt = rows.select(part, "window", *ints).repartition(min(parts, n_partitions(rows.sparkSession)), "part")  # a number given is kept, so small blocks are not put in one task
    return stored(dealt.groupBy("part").applyInArrow(pack, BLOCK), "secret-blocks")


def _one_pass(blocks: DataFrame, network: Network, weight: np.ndarray, number: int) -> Network:
    """The mean of what ``network`` becomes by a pass over each block; ``weight`` is that of each kind's candidates."""
    shared = blocks.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        total = np.zeros(net.flat().size + 1, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                part, windows, before, size, bits = (batch.column(k)[i].as_py() for k in range(5))
                y = _bits(np.array(bits, np.int64))
                fitted = net.fit(windows, [(b, b + n) for b, n in zip(before, size, strict=True)], y, np.where(y > 0, weight, 1.0).astype(np.float32), 1_000_003 * part + number)
                total += np.r_[np.rint(fitted.flat() * float(UNIT)).astype(np.int64), 1]
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "total"])

    sums = blocks.mapInArrow(frugal(run), "slot int, total long").groupBy("slot").agg(F.sum("total").alias("total")).toArrow().sort_by("slot")["total"].to_numpy()
    shared.unpersist()
    return network.filled(sums[:-1] / (float(UNIT) * sums[-1]))


def _bits(bits: np.ndarray) -> np.ndarray:
    """A column of 0 and 1 for each kind."""
    return (bits[:, None] >> np.arange(len(KINDS)) & 1).astype(np.float32)


def _outputs(rows: DataFrame, network: Network) -> DataFrame:
    """kind, step and how many candidates of the kind (good) and others have that output."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            window, before, size, bits = (batch.column(k).to_pylist() for k in range(4))
            steps = shared.value.steps(window, [(b, b + n) for b, n in zip(before, size, strict=True)])
            good = _bits(np.array(bits, np.int64)) > 0
            kinds = np.tile(np.arange(len(KINDS), dtype=np.int32), len(steps))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(steps.ravel()), pa.array(good.ravel())], ["kind", "step", "good"])

    each = rows.select("window", "before", "size", "bits").mapInArrow(frugal(run), "kind int, step int, good boolean")
    return each.groupBy("kind", "step").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("other"))


def train(scanned: DataFrame, labelled: DataFrame | None = None, recall: float = 0.95) -> Network:
    """A network fitted and calibrated on all distinct candidates: window, its context before, its length, and kinds as bits.

    The rules' own findings are the labelled ones, or ``labelled`` (window, before, size, bits) if given. A quarter, by a hash of
    the window, is held back for calibration; the rest is dealt over blocks of about ``BLOCK_ROWS``. In each pass every block is
    fitted in a task of its own from the same network, and their mean is the next one. To the driver come one sum for each
    parameter and the held-back outputs' counts. A rerun gives the same network, however the rows are dealt over tasks.
    """
    if labelled is None:
        each = scanned.select(F.explode(F.arrays_zip("starts", "ends", "windows", "bits")).alias("c"))
        before = F.least(F.col("c.starts"), F.lit(BEFORE))
        labelled = each.select(F.col("c.windows").alias("window"), before.alias("before"), (F.col("c.ends") - F.col("c.starts")).alias("size"), F.col("c.bits").alias("bits"))
    ship(scanned.sparkSession)
    distinct = labelled.groupBy("window", "before", "size").agg(F.bit_or("bits").alias("bits"))
    rows = stored(distinct.withColumn("held", F.pmod(F.xxhash64(F.lit(13), "window", "before"), F.lit(4)) == 0), "secret-labels")
    fitted, held = rows.where(~F.col("held")), rows.where("held")
    kinds = [F.count_if(F.col("bits").bitwiseAND(1 << k) > 0).alias(f"k{k}") for k in range(len(KINDS))]
    sizes = {r["held"]: r for r in rows.groupBy("held").agg(F.count("*").alias("n"), F.sum(F.length("window")).alias("chars"), *kinds).collect()}
    network = Network.fresh()
    if len(sizes) < 2 or not any(r[f"k{k}"] for r in sizes.values() for k in range(len(KINDS))):
        return network
    n, found = sizes[False]["n"], np.array([sizes[False][f"k{k}"] for k in range(len(KINDS))])
    weight = ((n - found) / np.maximum(1, found)).clip(1, 20)
    blocks = _blocks(fitted, max(1, -(-n // BLOCK_ROWS), -(-sizes[False]["chars"] // BLOCK_CHARS)))
    for number in range(EPOCHS):
        network = _one_pass(blocks, network, weight, number)
    counts = _outputs(held, network).toPandas().sort_values("step")
    for k, mine in counts.groupby("kind"):
        network.calibrate(int(k), *(mine[c].to_numpy(np.int64) for c in ("step", "good", "other")), recall)
    return network


def judge(scanned: DataFrame, network: Network) -> DataFrame:
    """doc_id, base and added findings as arrays of kind, start and end in turn, and the chances of each candidate.

    Added are candidates that touch no base finding and reach the threshold of a kind; the kind most above its own counts.
    """
    shared = scanned.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            starts, ends, windows, touched = (batch.column(batch.schema.get_field_index(c)) for c in ("starts", "ends", "windows", "touched"))
            sizes = np.array([len(x) for x in starts.to_pylist()], np.int64)
            a, b = starts.flatten().to_numpy(), ends.flatten().to_numpy()
            before = np.minimum(a, BEFORE)
            scores = net.scores(windows.flatten().to_pylist(), list(zip(before.tolist(), (before + b - a).tolist(), strict=True)))
            margin = scores - net.threshold
            add = (margin.max(axis=1, initial=-np.inf) >= 0) & ~touched.flatten().to_numpy(zero_copy_only=False).astype(bool)
            spans = np.stack([margin.argmax(axis=1) if len(a) else a, a, b], axis=1)[add]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            per_row = np.bincount(owner[add], minlength=len(sizes))
            offsets = np.r_[0, np.cumsum(3 * per_row)]
            added = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(spans.ravel().astype(np.int32)))
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(len(KINDS) * sizes)].astype(np.int32)), pa.array(scores.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), added, flat], ["doc_id", "base", "added", "chances"])

    columns = ["doc_id", "base", "starts", "ends", "windows", "bits", "touched"]
    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.select(columns).mapInArrow(frugal(run), f"doc_id {kind}, base array<int>, added array<int>, chances array<double>")


def listed(spans: list[int]) -> str:
    """``kind:start:end`` of findings given as kind, start, end in turn, by start, then kind, joined by commas."""
    rows = sorted(zip(spans[::3], spans[1::3], spans[2::3], strict=True), key=lambda s: (s[1], s[0], s[2]))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in rows)


def secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (base findings), base_sha256, spans (base and added) and n_added of every document.

    Null texts count as empty; equal texts give equal results; repeated rows and null ids are kept; other columns are left
    out; an empty table gives no rows. Where no rule finds anything the network has nothing to learn and adds nothing.
    """
    scanned = stored(scan(docs, id_col, text_col), "secret-scan")
    judged = judge(scanned, train(scanned, labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            counts = [pa.array([b[::3].count(k) for b in base], pa.int64()) for k in range(len(KINDS))]
            hashes = [hashlib.sha256(listed(b).encode()).hexdigest() for b in base]
            spans = [listed(b + a) for b, a in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array([len(a) // 3 for a in added], pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return judged.mapInArrow(frugal(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
