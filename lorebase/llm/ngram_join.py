"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence.

Equal sets are one class from the start. Candidates meet by equal parts of their sets (see ``part_keys``) and
similar sketches; components of candidates are the blocks of the incidence matrix, and each block is multiplied with its own
transpose in a task. Only links, class ids and hashes are shuffled besides the sets of the candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.llm.common import ROW, discard, frugal, slices, table
from lorebase.llm.components import components
from lorebase.llm.shingles import mix, set_key, shingle_sets
from lorebase.workers import ship

#: Documents and shingles to a block of the matrix, at most; larger groups of candidates are multiplied block by block.
BLOCK, BLOCK_SHINGLES = 256, 400_000
#: Shingles a task multiplies at once, about, and keys it holds.
CHUNK, KEYS = 800_000, 200_000
#: Bins of a sketch, at least and at most.
BINS, MOST_BINS = 64, 4096
LONG = pa.int64()


class Sizes:
    """Size classes in which linked sets are the same or neighbours, for num/100 as least similarity."""

    def __init__(self, percent: int) -> None:
        self.percent, self.edges = percent, [1, 2]
        while self.edges[-1] < 1 << 40:
            last = self.edges[-1]
            self.edges.append(max(last + 1, (last - 1) * 100 // percent + 1))
        self.array = np.array(self.edges)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.array, n, side="right")) - 1

    def differing(self, scheme: int) -> int:
        """Most elements that are in only one of two linked sets of size class scheme - 1 or scheme."""
        largest = self.edges[scheme + 1] - 1
        return 2 * largest * (100 - self.percent) // (100 + self.percent)


def part_keys(s: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Keys of a set such that any two linked sets have one in common.

    Two linked sets differ in at most d elements. Elements are dealt by hash into d + 1 + spare parts, so more
    than ``spare`` parts are equal in both; a part's key is the sum of its mixed elements. Equal parts may all
    be empty only if both sets have more than ``spare`` empty parts: such sets (few elements, an unlucky
    deal) add keys for single elements, enough that linked ones share one. A set is dealt for its own size
    class and for the next one, since a linked set may be in either.
    """
    out, own = [], sizes.of(len(s))
    for scheme in (own, own + 1):
        d = sizes.differing(scheme)
        spare = 1 + d // 16
        parts = d + 1 + spare
        part = (mix(s ^ np.uint64(scheme * 0x9E37 + 1)) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        part = part.astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, starts = np.unique(part[order], return_index=True)
        sums = np.add.reduceat(mix(s[order] + np.uint64(0x51ED270B)), starts)
        out.append(mix(sums + mix(found.astype(np.uint64) + np.uint64(scheme << 40))))
        if parts - len(found) > spare:
            few = len(s) - -(-len(s) * sizes.percent // 100) + 1
            out.append(mix(s[:few] ^ np.uint64((scheme << 20) + 0x7F4A7C15)))
    return np.unique(np.concatenate(out))


def _class_id(s: np.ndarray) -> int:
    return int.from_bytes(set_key(s)[:8], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """Numbers of elements in hash bins, 255 at most; the larger the set, the more bins (64 to 4,096, powers of two).

    The bins of two sets differ by no more than the sets do, and neighbouring bins add up to coarser ones.
    """
    bins = BINS
    while bins < MOST_BINS and bins * 16 < len(s):
        bins *= 2
    place = (mix(s ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    return np.minimum(np.bincount(place, minlength=bins), 255).astype(np.uint8).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """Least number of elements in which two sets differ, by their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) == len(y):
        return int(np.abs(x.astype(np.int64) - y).sum())
    if len(x) > len(y):
        x, y = y, x
    full = y.astype(np.int64).reshape(len(x), -1)
    capped = (full == 255).any(axis=1) | (x == 255)  # sums of capped bins say nothing
    return int(np.abs(x.astype(np.int64) - full.sum(axis=1))[~capped].sum())


def classes(docs: DataFrame, width: int, kind: str = "long") -> DataFrame:
    """doc_id (of type ``kind``), n (size of the set), cid (id of the class of equal sets; null for an empty set) and sketch of (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], LONG), pa.array([_class_id(s) if len(s) else None for s in sets], LONG), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], ["doc_id", "n", "cid", "sketch"])

    return docs.mapInArrow(frugal(run), f"doc_id {kind}, n long, cid long, sketch binary")


def candidate_groups(docs: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """v, label: classes and the smallest class that pairs connect them with, of all pairs that share a key and may be linked by their sketches.

    ``known`` has (cid, n, sketch) of every class. A task sends the keys of a class once, however many copies it
    reads. Keys that only one class has end there; the others' classes are joined with their sketches, and
    inside a list pairs that differ too much in the bins are no candidates, whatever key they share.

    Each list has its own pairs, which in a group of near copies would be nearly all pairs of the group. Classes
    are so connected first in the list of their smallest shared key only, less than a pair a class; of all lists those
    pairs follow that connect what is still apart, as pairs of what was connected.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = Sizes(percent), set()
        k, c, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            key, cid = np.concatenate(k).view(np.int64), np.concatenate(c)
            k.clear(), c.clear()
            held = 0
            for at in range(0, len(key), KEYS):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + KEYS]), pa.array(cid[at : at + KEYS])], ["key", "cid"])

        for batch in slices(batches, 1):
            for s in shingle_sets(batch.column(1).to_pylist(), width):
                if len(s) and (cid := _class_id(s)) not in seen:
                    seen.add(cid)
                    k.append(part_keys(s, sizes))
                    c.append(np.full(len(k[-1]), cid, np.int64))
                    held += len(k[-1])
                    if held >= KEYS:
                        yield from flush()
        if held:
            yield from flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and class those whose key another class has; each pair of key and class once."""
        held_key, held_cid, sent = None, None, False
        for batch in batches:
            key, cid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(key):
                continue
            if held_key is not None:
                key, cid = np.r_[held_key, key], np.r_[held_cid, cid]
            again = np.r_[False, (key[1:] == key[:-1]) & (cid[1:] == cid[:-1])]
            same = key[1:] == key[:-1]
            differs = same & (cid[1:] != cid[:-1])
            keep = (np.r_[False, differs] | np.r_[differs, False]) & ~again
            if again.any():  # a repeated row stands between a class and the next one
                run = np.cumsum(~again) - 1
                keep = (np.bincount(run, np.r_[False, differs] | np.r_[differs, False]) > 0)[run] & ~again
            if held_key is not None and sent:
                keep[0] = False
            last_sent = bool((np.bincount(np.cumsum(~again) - 1, keep) > 0)[-1]) or (sent and held_key == key[-1] and held_cid == cid[-1])
            held_key, held_cid, sent = key[-1], cid[-1], last_sent
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cid[keep])], ["key", "cid"])

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes, int]] = []

        def flush() -> pa.RecordBatch:
            key, cid, n, label = (np.array([x[i] for x in rows], np.int64) for i in (0, 1, 2, 4))
            sketches = [x[3] for x in rows]
            rows.clear()
            long = np.array([len(x) > BINS for x in sketches])
            bins = np.frombuffer(b"".join(bytes(BINS) if w else x for x, w in zip(sketches, long, strict=True)), np.uint8).reshape(-1, BINS).astype(np.int16)
            bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
            a, b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                left = np.arange(lo, hi)
                while len(left) and (label[left] != label[left[0]]).any():
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        i = front.pop()
                        if long[left].any() or long[i]:
                            differ = np.array([apart(sketches[i], sketches[j]) for j in left.tolist()])
                        else:
                            differ = np.abs(bins[left] - bins[i]).sum(axis=1, dtype=np.int64)
                        near = differ * (100 + percent) <= (n[left] + n[i]) * (100 - percent)
                        found = left[near]
                        apart_yet = found[label[found] != label[i]]
                        a += [int(label[i])] * len(apart_yet)
                        b += label[apart_yet].tolist()
                        front += found.tolist()
                        left = left[~near]
            return pa.RecordBatch.from_arrays([pa.array(a, LONG), pa.array(b, LONG)], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(rows) >= 20_000 and row[0] != rows[-1][0]:
                    yield flush()
                rows.append(row)
        if rows:
            yield flush()

    spread = docs.mapInArrow(frugal(keys), "key long, cid long").repartition("key").sortWithinPartitions("key", "cid")
    lists = table(spread.mapInArrow(frugal(shared), "key long, cid long"), "ngram-lists")

    def pairs(rows: DataFrame, of_class: DataFrame) -> DataFrame:
        with_bins = rows.join(of_class.hint("merge"), "cid").select("key", "cid", "n", "sketch", "label")
        return with_bins.repartition("key").sortWithinPartitions("key", "cid").mapInArrow(frugal(prune), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    bins = known.select("cid", "n", "sketch")
    first = components(pairs(lists.groupBy("cid").agg(F.min("key").alias("key")), bins.withColumn("label", F.col("cid"))))
    of_first = first.withColumnsRenamed({"v": "cid", "label": "own"})
    second = components(pairs(lists, bins.join(of_first, "cid", "left").withColumn("label", F.coalesce("own", "cid")).drop("own")))
    further = second.withColumnsRenamed({"v": "own", "label": "to"})
    moved = of_first.join(further, "own", "left").select(F.col("cid").alias("v"), F.coalesce("to", "own").alias("label"))
    out = table(moved.unionByName(second.join(first.select("v"), "v", "left_anti")), "ngram-groups")
    discard(lists, first, second)
    return out


def _product(unit: np.ndarray, side: np.ndarray, cid: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[list[int], list[int], np.ndarray]:
    """Links of a chunk: a spanning set of them as two lists of class ids, and the links counted for each row.

    Rows of the same unit are multiplied: all pairs of side 0, and pairs of side 1 with side 2. Rows stand in order of
    size, so that a row's partners, which may be larger by 100 / percent at most, are a range of the rows after it; counts
    of pairs beyond that bound are dropped before they are added up. Two blocks that meet are connected in themselves first, by
    links that their own units give, so that of all links across only those go on that connect what is still apart.
    """
    by_size = np.argsort([len(s) for s in sets], kind="stable")
    unit, side, cid, sets = unit[by_size], side[by_size], cid[by_size], [sets[i] for i in by_size]
    lengths = np.array([len(s) for s in sets])
    beyond = np.searchsorted(lengths, lengths * 100 // percent, side="right")
    gram = mix(np.concatenate(sets) ^ np.repeat(mix(unit.view(np.uint64)), lengths))
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(gram, kind="stable")
    column = np.empty(len(gram), np.int64)
    bounds = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
    counts = np.diff(np.r_[bounds, len(gram)])
    column[order] = np.repeat(np.arange(len(bounds)), counts)
    holders = owner[order]
    up = np.arange(len(sets))

    def roots(x: np.ndarray) -> np.ndarray:
        top = up[x]
        while (up[top] != top).any():
            top = up[top]
        return top

    def join(i: int, others: np.ndarray) -> list[int]:
        """Connects row i with ``others``, of which those are returned that were apart from it and from one another."""
        top, first = np.unique(roots(np.r_[i, others]), return_index=True)
        up[top] = up[i] = up[others] = top[0]
        return others[first[first > 0] - 1].tolist()

    a, b, across, links, at = [], [], [], np.zeros(len(sets), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        mine = column[at : at + n]
        at += n
        mine = mine[counts[mine] > 1]
        if not len(mine):
            continue
        c = counts[mine]
        places = np.repeat(bounds[mine] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(c.sum())
        others = holders[places]
        others = others[(others > i) & (others < beyond[i])]
        if not len(others):
            continue
        found, overlap = np.unique(others, return_counts=True)
        linked = 100 * overlap >= percent * (n + lengths[found] - overlap)
        found = found[linked & (cid[found] != cid[i])]
        if not len(found):
            continue
        met = found[side[found] != side[i]] if side[i] else found
        links[i] += len(met)
        links[met] += 1
        new = join(i, found[side[found] == side[i]])
        if not side[i]:
            a += [int(cid[i])] * len(new)
            b += cid[new].tolist()
        elif len(met):
            across.append((i, met[np.unique(roots(met), return_index=True)[1]]))
    for i, met in across:
        new = join(i, met)
        a += [int(cid[i])] * len(new)
        b += cid[new].tolist()
    back = np.empty_like(links)
    back[by_size] = links
    return a, b, back


def links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (a, b, n) of all links between different classes of the same group: a spanning set (n null), and n links of class a (b null).

    ``members`` has (doc_id, cid, grp, n): one document of each candidate class and the size of its set. A group of more than BLOCK
    classes, or BLOCK_SHINGLES shingles, is cut by size class and hash; blocks of equal or neighbouring size class are multiplied pair by
    pair, so that no task gets an unbounded group, and blocks too far apart in size never meet.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column(0).to_pylist(), width)
            right = [i for i, (s, c) in enumerate(zip(sets, batch.column(1).to_pylist(), strict=True)) if len(s) and _class_id(s) == c]
            kept = batch.take(pa.array(right, LONG))
            yield pa.RecordBatch.from_arrays([*kept.columns[1:], pa.array([sets[i].tobytes() for i in right], pa.binary())], ["cid", "grp", "size_class", "small", "own", "below", "above", "grams"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        held = 0

        def flush(upto: int) -> pa.RecordBatch:
            nonlocal held
            part = rows[:upto]
            del rows[:upto]
            sets = [np.frombuffer(x[3], np.uint64) for x in part]
            a, b, n = _product(np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], np.int64), cid := np.array([x[2] for x in part], np.int64), sets, percent)
            held -= sum(map(len, sets))
            has = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(a + cid[has].tolist(), LONG), pa.array(b + [None] * len(has), LONG), pa.array([None] * len(a) + n[has].tolist(), LONG)], ["a", "b", "n"])

        for batch in slices(batches, 3):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held >= CHUNK and row[0] != rows[-1][0]:
                    yield flush(len(rows))
                rows.append(row)
                held += len(row[3]) // 8
        if rows:
            yield flush(len(rows))

    edges = F.array(*(F.lit(e) for e in Sizes(percent).edges if e < 1 << 40))
    own_class = F.size(F.filter(edges, lambda e: e <= F.col("n"))) - 1
    placed = members.select(F.col("doc_id").alias("m_id"), "cid", "grp", "n", own_class.alias("size_class"))
    per = table(placed.groupBy("grp", "size_class").agg(F.count("*").alias("k"), F.sum("n").alias("work")), "ngram-sizes")
    whole = Window.partitionBy("grp")
    per = per.withColumn("fits", (F.sum("k").over(whole) <= BLOCK) & (F.sum("work").over(whole) <= BLOCK_SHINGLES)).withColumn("own", F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("work") / BLOCK_SHINGLES)).cast("int"))
    by_size = Window.partitionBy("grp").orderBy("size_class")
    beside = lambda step: F.coalesce(F.when(step("size_class").over(by_size) == F.col("size_class") + (1 if step is F.lead else -1), step("own").over(by_size)), F.lit(0))
    per = per.select("grp", "size_class", F.col("fits").alias("small"), "own", beside(F.lag).alias("below"), beside(F.lead).alias("above"))
    chosen = placed.join(per, ["grp", "size_class"])
    sets = docs.join(chosen.hint("merge"), F.col("doc_id").eqNullSafe(F.col("m_id"))).select("text", "cid", "grp", "size_class", "small", "own", "below", "above").mapInArrow(frugal(read), "cid long, grp long, size_class int, small boolean, own int, below int, above int, grams binary")
    block = F.pmod(F.xxhash64("cid"), F.col("own")).cast("int")
    # A large group's unit is a pair of blocks (size class, part): the lower block is side 1, the higher side 2; side 0 is a block with itself.
    me = (F.col("size_class"), block)

    def unit(low, high, side):
        return F.struct(F.xxhash64(F.col("grp"), low[0], low[1], high[0], high[1]).alias("unit"), F.lit(side).alias("side"))

    def parts(count):
        return F.when(count > 0, F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))

    up, down = (F.col("size_class") + 1).cast("int"), (F.col("size_class") - 1).cast("int")
    same = F.transform(parts(F.col("own")), lambda k: F.when(k < block, unit((F.col("size_class"), k), me, 2)).when(k > block, unit(me, (F.col("size_class"), k), 1)).otherwise(unit(me, me, 0)))
    below = F.transform(parts(F.col("below")), lambda k: unit((down, k), me, 2))
    above = F.transform(parts(F.col("above")), lambda k: unit(me, (up, k), 1))
    alone = F.array(F.struct(F.xxhash64("grp").alias("unit"), F.lit(0).alias("side")))
    units = sets.select("cid", "grams", F.explode(F.when(F.col("small"), alone).otherwise(F.concat(same, below, above))).alias("u"))
    units = units.select("u.unit", "u.side", "cid", "grams").repartition("unit").sortWithinPartitions("unit", "side", "cid")
    return units.mapInArrow(frugal(multiply), "a long, b long, n long")


def _joined(slim: DataFrame, of_doc: DataFrame, width: int, percent: int) -> DataFrame:
    """cid, component_id (smallest doc_id that is not null), least (smallest cid) of the component, n_links of every class.

    ``slim`` has (doc_id, text), ``of_doc`` the written (doc_id, n, cid, sketch) of the same rows.
    """
    by_class = table(of_doc.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("first_id"), F.max("n").alias("n"), F.max("sketch").alias("sketch")), "ngram-by-class")
    groups = candidate_groups(slim, by_class, width, percent)
    reps = by_class.join(groups.select(F.col("v").alias("cid"), F.col("label").alias("grp")), "cid").select(F.col("first_id").alias("doc_id"), "cid", "grp", "n")
    found = table(links(slim, table(reps, "ngram-members"), width, percent), "ngram-links")
    by_class = by_class.select("cid", "first_id")
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("v", "cid")
    n_links = found.where("b IS NULL").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_links"))
    least = by_class.join(joined, "cid").groupBy("label").agg(F.min("first_id").alias("least_id"))
    out = by_class.join(joined.join(least, "label").select("cid", "label", "least_id"), "cid", "left").join(n_links, "cid", "left")
    out = table(out.select("cid", F.coalesce("least_id", "first_id").alias("component_id"), F.coalesce("label", "cid").alias("least"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "ngram-components")
    discard(groups, found)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every document.

    A document's set: distinct shingles of ``width`` words (between white space, A-Z lower-cased); with fewer
    words the whole sequence is one; without words, or null, it is empty and linked with nothing. Two
    documents link when 100 * intersection >= percent * union of their sets. component_id is the smallest
    doc_id reachable by links (of an empty set: its own). n_links counts the different sets its set links with;
    equal sets link all their documents without being pairs.

    Sets are compared by 64-bit hashes of their shingles. Null ids are documents whose component is the
    smallest id that is not null, else null; repeated rows are documents of their own; an empty table gives no
    rows; other columns are left out.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    of_doc = table(classes(slim, width), "ngram-classes")
    out = _joined(slim, of_doc, width, percent).drop("least")
    empty = of_doc.where("cid IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return of_doc.where("cid IS NOT NULL").join(out, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links").unionByName(empty)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, one of each component of near duplicates.

    The row of the smallest id stays, null ids last; of rows with one id that of the smallest hash of the text, and of rows
    that have both in common one. Rows without words are linked with nothing and all stay, repeated or not. An empty table
    gives no rows.

    Rows are known by their id and a 128-bit hash of the text. What goes is written as a table of such pairs, small beside
    the documents, so that Spark may leave the texts where they are.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hashed = slim.select(F.struct("doc_id", F.md5("text").alias("h")).alias("doc_id"), "text")
    with_hash = table(classes(hashed, width, "struct<doc_id:bigint,h:string>").select("doc_id.doc_id", "doc_id.h", "n", "cid", "sketch"), "ngram-classes")
    joined = _joined(slim, with_hash, width, percent)
    rows = with_hash.where("cid IS NOT NULL").join(joined.select("cid", "least"), "cid").groupBy("least", "doc_id", "h").agg(F.count("*").alias("copies"))
    stays = rows.groupBy("least").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h")).alias("s"))
    judged = table(rows.join(stays, "least").select("doc_id", "h", "copies", (F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("h") == F.col("s.h"))).alias("stays")), "ngram-judged")
    known = lambda df: df.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.md5(F.col(text_col).cast("string")) == F.col("_h"))
    kept = docs.join(known(judged.where("NOT stays")), same, "left_anti")
    again = known(judged.where("stays AND copies > 1"))
    if again.isEmpty():
        return kept
    order = Window.partitionBy(F.col(f"{ROW}.{id_col}"), F.md5(F.col(f"{ROW}.{text_col}").cast("string"))).orderBy(F.md5(F.to_json(ROW)))
    one = kept.join(again, same, "left_semi").select(F.struct("*").alias(ROW)).withColumn("_n", F.row_number().over(order)).where("_n = 1").select(f"{ROW}.*")
    return kept.join(again, same, "left_anti").unionByName(one)
