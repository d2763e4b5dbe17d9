"""K1: words of a text by the likeliest cut over a lexicon, found with a double-array trie for all texts of a batch at once."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from lorebase.functions.text import ngrams
from lorebase.workers import ship

#: Weights are logarithms in millionths, as integers, so that sums are exact and ties certain.
SCALE = 1_000_000
NONE = -(1 << 60)
#: Characters of texts that are cut together.
CHARS = 1 << 18


class Trie:
    """A double array: from state s the character of code c leads to ``base[s] + c`` if ``check`` there is s."""

    def __init__(self, lexicon: Mapping[str, float]) -> None:
        total = sum(lexicon.values())
        weight = {w: round(math.log(f / total) * SCALE) for w, f in lexicon.items() if w and f > 0}
        self.other = round(math.log(0.5 / total) * SCALE)
        self.longest = max(map(len, weight), default=1)
        self.points = np.array(sorted({ord(c) for w in weight for c in w}), np.int64)
        code = {int(p): i + 1 for i, p in enumerate(self.points)}
        tree: dict = {}
        for w, x in weight.items():
            node = tree
            for c in w:
                node = node.setdefault(code[ord(c)], {})
            node[0] = x
        # States are laid out level by level; a state's children take the first free places that fit them all.
        base, check, value, used = [0], [0], [NONE], bytearray(b"\1")
        level, free = [(0, tree)], 1
        while level:
            after = []
            for state, node in level:
                kids = sorted(k for k in node if k)
                value[state] = node.get(0, NONE)
                if not kids:
                    continue
                place = max(free, kids[0] + 1)
                while True:
                    place = used.find(b"\0", place)
                    if place < 0:
                        place = max(len(used), kids[0] + 1)
                    at = place - kids[0]
                    if not any(used[at + k] for k in kids if at + k < len(used)):
                        break
                    place += 1
                more = at + kids[-1] + 1 - len(used)
                if more > 0:
                    used += bytes(more)
                    base += [0] * more
                    check += [-1] * more
                    value += [NONE] * more
                base[state] = at
                for k in kids:
                    used[at + k], check[at + k] = 1, state
                    after.append((at + k, node[k]))
                free = used.find(b"\0", free)
                free = len(used) if free < 0 else free
            level = after
        self.base, self.check, self.value = (np.array(x, np.int64) for x in (base, check, value))

    def arcs(self, points: np.ndarray) -> np.ndarray:
        """For each length from 1 on and each place the weight of the word that starts there; a single character always has one."""
        place = np.minimum(np.searchsorted(self.points, points), max(0, len(self.points) - 1))
        codes = np.where(self.points[place] == points, place + 1, 0) if len(self.points) else np.zeros(len(points), np.int64)
        out = np.full((self.longest + 1, len(points)), NONE, np.int64)
        starts, state = np.arange(len(points)), np.zeros(len(points), np.int64)
        for d in range(1, self.longest + 1):
            inside = starts + d <= len(points)
            starts, state = starts[inside], state[inside]
            c = codes[starts + d - 1]
            to = self.base[state] + c
            ok = (c > 0) & (to < len(self.check)) & (self.base[state] > 0)
            ok[ok] = self.check[to[ok]] == state[ok]
            starts, state = starts[ok], to[ok]
            out[d, starts] = self.value[state]
        out[1] = np.where(out[1] == NONE, self.other, out[1])
        return out

    def cut(self, points: np.ndarray) -> np.ndarray:
        """Places where the words of the likeliest cut end, of equal ones that with the longest first word.

        Where no word of several characters crosses a place, the text falls apart; the parts are solved together, from their ends.
        """
        n = len(points)
        arcs = self.arcs(points)
        over = np.zeros(n + 1, np.int64)
        for d in range(2, self.longest + 1):
            at = np.flatnonzero(arcs[d] > NONE)
            np.add.at(over, at + 1, 1)
            np.add.at(over, at + d, -1)
        edges = np.r_[np.flatnonzero(np.cumsum(over[:n]) == 0), n]
        starts, sizes = edges[:-1], np.diff(edges)
        best, to = np.zeros(n + 1, np.int64), np.arange(1, n + 1)
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        best[starts[sizes == 1]] = 0  # a part of one place needs no choice
        for t in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            many = int(np.searchsorted(-sizes, -max(t, 2), "right"))
            ends = starts[:many] + sizes[:many]
            i = ends - t
            top = np.full(many, NONE, np.int64)
            for d in range(1, min(t, self.longest) + 1):
                score = np.where(arcs[d, i] > NONE, arcs[d, i] + np.where(t > d, best[i + d], 0), NONE)
                better = (score >= top) & (score > NONE)
                top[better] = score[better]
                to[i[better]] = i[better] + d
            best[i] = top
        found, now, last = [], starts, starts + sizes
        while len(now):
            now = to[now]
            found.append(now)
            going = now < last
            now, last = now[going], last[going]
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def words(self, texts: list[str]) -> list[list[str]]:
        """Words of two characters or more of each text, in order."""
        joined = "\0".join(texts)  # in no word, so no word crosses it
        ends = self.cut(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64))
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        long = ends - begins >= 2
        out: list[list[str]] = [[] for _ in texts]
        bounds = np.cumsum([len(t) + 1 for t in texts])
        for k, a, b in zip(np.searchsorted(bounds, begins[long], "right").tolist(), begins[long].tolist(), ends[long].tolist(), strict=True):
            out[k].append(joined[a:b])
        return out


def segment(df: DataFrame, lexicon: Mapping[str, float] | None = None, stop: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """K1: adds terms: words of two characters or more with a CJK one that are no stop words, by the likeliest cut over a lexicon of weights, distinct in first order.

    A null text has no terms. Without a lexicon terms are CJK pairs (``lorebase.functions.text.ngrams``), in built-in expressions. The
    trie, about 24 bytes for each character of the lexicon, is sent to all tasks.
    """
    if not lexicon:
        return df.withColumn("terms", F.filter(ngrams(F.col(text)), lambda w: ~w.isin(*stop)) if stop else ngrams(F.col(text)))
    if any("\0" in w for w in lexicon):
        raise ValueError("a lexicon's words hold no character 0")
    shared = df.sparkSession.sparkContext.broadcast((Trie(lexicon), frozenset(stop)))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, stops = shared.value
        for batch in batches:
            sizes = pa.compute.utf8_length(batch.column(names.index(text))).fill_null(0).to_pylist()
            first = 0
            while first < len(sizes):
                past, held = first, 0
                while past < len(sizes) and (past == first or held + sizes[past] <= CHARS):
                    held += sizes[past]
                    past += 1
                part = batch.slice(first, past - first)  # passed on with its terms, so that no more than these are held
                found = trie.words([(t or "").replace("\0", " ") for t in part.column(names.index(text)).to_pylist()])
                terms = [[w for w in dict.fromkeys(ws) if w not in stops and any("一" <= c <= "龥" for c in w)] for ws in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(terms, pa.list_(pa.string()))], [*names, "terms"])
                first = past

    ship(df.sparkSession)
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("terms", ArrayType(StringType()))]))
