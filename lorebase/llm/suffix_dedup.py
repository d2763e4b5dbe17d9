"""Suffix-array dedup: maximal repeats of at least ``least`` bytes with all occurrences, and texts without them.

Every string of ``least`` bytes contains an anchor: the 32-byte string with the smallest hash in it. Equal
strings have equal anchors at equal places, so only places whose anchor occurs twice can repeat (about one in
35 bytes is an anchor, and few of those repeat). Each group of equal anchors is a sparse enhanced suffix array:
the suffixes from the anchors on, sorted, with their common prefixes. A stack scan of the common prefixes gives
the interval tree; inside an interval the contexts to the left, sorted backwards, are scanned the same way, and
an interval whose left extensions differ is a maximal repeat of all its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorebase.llm.common import ROW, frugal, release, slices, table
from lorebase.llm.shingles import _powers, mix
from lorebase.workers import ship

#: Bytes of an anchor.
ANCHOR = 32
#: Bytes of text hashed at once, anchors compared at once in a reading task, contexts at once in a group task.
TEXT, HELD, CONTEXTS = 500_000, 400_000, 12_000
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
LONG = pa.int64()


def string_id(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every w neighbours."""
    size, out = 1, v
    while size * 2 <= w:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(v) - w + 1], out[w - size : w - size + len(v) - w + 1])


def anchors(texts: list[bytes], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the places of its anchors and their hashes."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(texts):
        batch, size = [], 0
        while at < len(texts) and (not batch or size + len(texts[at]) <= TEXT):
            batch.append(texts[at])
            size += len(texts[at])
            at += 1
        if size > TEXT:  # one long text: pieces that share least - 1 bytes
            out.append(_long_anchors(batch[0], least))
            continue
        out += _anchors(batch, least)
    return out


def _long_anchors(text: bytes, least: int) -> tuple[np.ndarray, np.ndarray]:
    places, hashes = [], []
    for start in range(0, len(text), TEXT):
        p, h = _anchors([text[start : start + TEXT + least - 1]], least)[0]
        places.append(p + start)
        hashes.append(h)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def _anchors(texts: list[bytes], least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(raw) < least:
        return [none for _ in texts]
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:-1], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: len(raw) - ANCHOR + 1])
    packed = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
    chosen = (_window_min(packed, least - ANCHOR + 1) & np.uint64(0xFFFFFF)).astype(np.int64)  # by window start
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    out = []
    for start, n in zip((ends - lengths).tolist(), lengths.tolist(), strict=True):
        if n < least:
            out.append(none)
            continue
        own = chosen[start : start + n - least + 1]
        own = own[np.r_[True, own[1:] != own[:-1]]]
        out.append((own - start, h[own].view(np.int64)))
    return out


def lcp_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of every interval of the tree of common prefixes with length at least ``least``.

    ``lcp[i]`` is the common prefix of sorted entries i and i + 1. One pass with a stack: an interval opens
    where the common prefix grows and closes where it falls below.
    """
    stack: list[tuple[int, int]] = []  # (length, first)
    for i, n in enumerate([*lcp.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            yield first, i, length
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, first))


def _common(rows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the next, within both valid lengths."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differs = rows[1:] != rows[:-1]
    first = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return np.minimum(first, np.minimum(valid[1:], valid[:-1]))


def _order(rows: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Lexicographic order of rows of bytes, after the keys of ``before``."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort((*(words[:, i] for i in reversed(range(words.shape[1]))), *reversed(before)))


def intervals(gram: np.ndarray, right: np.ndarray, n_right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the contexts, and (first, last, length) of its common-prefix intervals; different grams share none."""
    order = _order(right, gram)
    lcp = _common(right[order], n_right[order])
    lcp[gram[order][1:] != gram[order][:-1]] = 0
    return order, np.array(list(lcp_intervals(lcp, ANCHOR)), np.int64).reshape(-1, 3)


def pairs(order: np.ndarray, tree: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """a, b, bytes to the left, bytes to the right of the repeats of intervals with two members, which most have, all at once."""
    tree = tree[tree[:, 1] == tree[:, 0] + 1]
    a, b, n = order[tree[:, 0]], order[tree[:, 1]], tree[:, 2]
    differs = left[a] != left[b]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), left.shape[1]) if left.shape[1] else np.zeros(len(a), np.int64)
    common = np.minimum(common, np.minimum(n_left[a], n_left[b]))
    kept = common + n >= least
    return a[kept], b[kept], common[kept], n[kept]


def scan(order: np.ndarray, tree: np.ndarray, left: np.ndarray, n_left: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, bytes to the left, bytes to the right of the anchor) of the repeats of intervals with three members or more.

    ``left`` holds contexts backwards from the anchor, and n_left says how many of those bytes there are. Inside an
    interval the left contexts are sorted and their own intervals are taken: each of them is left-extended alike.
    """
    for first, last, length in tree[tree[:, 1] > tree[:, 0] + 1].tolist():
        members = order[first : last + 1]
        need = max(0, least - length)
        members = members[n_left[members] >= need]
        if need and len(members) > 1:  # only members that share the bytes needed with another can be in a repeat
            key = left[members, :need]
            _, group, count = np.unique(np.ascontiguousarray(key).view(f"V{need}").ravel(), return_inverse=True, return_counts=True)
            members = members[count[group] > 1]
        if len(members) < 2:
            continue
        members = members[_order(left[members])]
        common = _common(left[members], n_left[members])
        for lo, hi, m in lcp_intervals(common, need):
            yield members[lo : hi + 1], m, length


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of intervals of each doc, in order."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    group = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    base = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * base)
    new = np.r_[True, start[1:] + group[1:] * base > reach[:-1]]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], reach[last] - group[last] * base


def _repeated_anchors(docs: DataFrame, least: int) -> DataFrame:
    """text_id, place, gram of the anchors that occur at two or more places of different texts.

    A task sorts the anchors it has read: those it holds twice are known to repeat and need no comparison;
    of each gram one goes to be compared with other tasks. So a frequent gram sends a row for each task.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, texts, places, held, seen = [], [], [], 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            gram, text, place = np.concatenate(grams), np.concatenate(texts), np.concatenate(places)
            grams.clear(), texts.clear(), places.clear()
            o = np.argsort(gram, kind="stable")
            gram, text, place = gram[o], text[o], place[o]
            new = np.r_[True, gram[1:] != gram[:-1]]
            twice = ~new | np.r_[~new[1:], False]
            # kind 0: compare; 1: compare, known to repeat; 2: known to repeat, goes past the comparison
            kind = np.where(new, twice.astype(np.int8), 2).astype(np.int8)
            key = np.where(kind == 2, mix((text + place).view(np.uint64)).view(np.int64), gram)
            for at in range(0, len(gram), 100_000):
                cut = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[cut]), pa.array(kind[cut]), pa.array(gram[cut]), pa.array(text[cut]), pa.array(place[cut].astype(np.int32))], ["key", "kind", "gram", "text_id", "place"])

        for batch in slices(batches):
            data = [t.encode() for t in batch.column(0).to_pylist()]
            ids = batch.column(1).to_pylist()
            new = []
            for i, x in enumerate(ids):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            for i, (p, h) in zip(new, anchors([data[i] for i in new], least), strict=True):
                if len(p):
                    grams.append(h)
                    texts.append(np.full(len(p), ids[i], np.int64))
                    places.append(p)
                    held += len(p)
            if held > HELD:
                yield from flush()
                held = 0
        if held:
            yield from flush()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by key: the rows of a key of which there is another, or that are known to repeat."""
        last: pa.RecordBatch | None = None
        waiting = False  # the last row of the batch before may still turn out to repeat
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            key, kind, text, place = (batch.column(i).to_numpy() for i in (0, 1, 3, 4))
            repeats = _repeats(key, kind, text, place)
            if waiting:
                repeats[0] = True
            emit = repeats.copy()
            emit[-1] = False
            yield batch.filter(pa.array(emit)).select(["text_id", "place", "gram"])
            last, waiting = batch.slice(batch.num_rows - 1), bool(repeats[-1])
        if last is not None and waiting:
            yield last.select(["text_id", "place", "gram"])

    spread = docs.select("text", "id").mapInArrow(frugal(read), "key long, kind byte, gram long, text_id long, place int").repartition("key").sortWithinPartitions("key", "text_id", "place")
    return spread.mapInArrow(frugal(compare), "text_id long, place int, gram long")


def _repeats(key: np.ndarray, kind: np.ndarray, text: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows that share their key with a row of another text or place. Copies of a text sent by several tasks are one."""
    same = (key[1:] == key[:-1]) & (kind[1:] < 2) & (kind[:-1] < 2)
    other = same & ((text[1:] != text[:-1]) | (place[1:] != place[:-1]))
    copy = same & ~other
    out = (kind > 0) | np.r_[False, other] | np.r_[other, False]
    if copy.any():  # what is true of one copy is true of all: along runs of the same row
        run = np.cumsum(np.r_[0, ~copy])
        out = np.bincount(run, out, run[-1] + 1)[run] > 0
    return out


def _by_text(anchors_found: DataFrame) -> DataFrame:
    """text_id with the places and grams of its anchors, each once, in order."""
    found = anchors_found.groupBy("text_id").agg(F.sort_array(F.collect_set(F.struct("place", "gram"))).alias("a"))
    return table(found.select("text_id", F.col("a.place").alias("places"), F.col("a.gram").alias("grams")), "suffix-anchors")


def _anchored(docs: DataFrame, firsts: DataFrame, found: DataFrame) -> DataFrame:
    """ord, text, text_id, places, grams of the first document of every text with anchors."""
    return found.join(firsts.withColumnRenamed("id", "text_id"), "text_id").join(docs.withColumnRenamed("id", "text_id"), ["text_id", "ord"]).select("ord", "text", "text_id", "places", "grams")


def repeat_intervals(docs: DataFrame, firsts: DataFrame, least: int = 100) -> DataFrame:
    """Repeated bytes of different texts: text_id, start, stop.

    ``docs`` has (ord, text, id), id a hash of the text, and ``firsts`` (id, ord) the smallest ord of every id:
    only the first document of equal texts has occurrences. Given out are the unions, per group task, of
    all occurrences that are not the repeat's first (smallest ord, then smallest start).
    """
    ship(docs.sparkSession)
    reach = least - ANCHOR
    found = _by_text(_repeated_anchors(docs, least))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of the anchors. Of equal contexts a task holds, one goes on; the others' bytes are known to repeat."""
        rows: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows.sort(key=lambda x: (x[0], x[4], x[5], x[3], x[1], x[2]))  # gram, contexts, then the order of occurrences
            gram, order, text, place, left, right, again = [], [], [], [], [], [], []
            before = None
            for x in rows:
                if before and x[:4] == before[:4]:
                    continue  # a repeated row of the table
                same = bool(before) and x[0] == before[0] and x[4:] == before[4:]
                gram.append(x[0])
                order.append(x[3])
                text.append(x[1])
                place.append(x[2])
                left.append(b"" if same else x[4])
                right.append(b"" if same else x[5])
                again.append(len(x[4]) << 16 | len(x[5]) if same else -1)
                before = x
            rows.clear()
            for at in range(0, len(gram), 20_000):
                c = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(gram[c], LONG), pa.array(order[c], LONG), pa.array(text[c], LONG), pa.array(place[c], pa.int32()), pa.array(left[c], pa.binary()), pa.array(right[c], pa.binary()), pa.array(again[c], pa.int32())], ["gram", "ord", "text_id", "place", "left", "right", "again"])

        for batch in slices(batches, 1):
            for doc, text, own, places, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = text.encode()
                for at in range(0, len(places), CONTEXTS):
                    rows += [(g, own, p, doc, data[max(0, p - reach) : p][::-1], data[p : p + least]) for p, g in zip(places[at : at + CONTEXTS], grams[at : at + CONTEXTS], strict=True)]
                    if len(rows) > CONTEXTS:
                        yield from flush()
        if rows:
            yield from flush()

    contexts = _anchored(docs, firsts, found).mapInArrow(frugal(cut), "gram long, ord long, text_id long, place int, left binary, right binary, again int")
    # Known bytes only pass through, so they are dealt evenly; contexts of a gram meet.
    spread = contexts.repartition(F.when(F.col("again") >= 0, F.xxhash64("text_id", "place")).otherwise(F.col("gram"))).sortWithinPartitions("gram")
    seed = spread.select(F.col("gram").alias("key"), F.lit(0).alias("l"), F.lit(ANCHOR).alias("r"), "gram", "ord", "text_id", "place", "left", "right", "again")
    out = table(seed.mapInArrow(frugal(_compare(least)), OUT), "suffix-compared")
    found = out.where("key IS NULL").select("text_id", "start", "stop")
    while not (late := out.where("key IS NOT NULL")).isEmpty():  # at most as many rounds as halvings of the bytes needed
        late = late.select("key", "l", "r", "gram", "ord", "text_id", "place", "left", "right", F.lit(-1).alias("again"))
        dealt = late.repartition("key").sortWithinPartitions("key", "left", "right", "ord", "text_id", "place")
        out = table(dealt.mapInArrow(frugal(_compare(least)), OUT), "suffix-compared")
        found = found.unionByName(out.where("key IS NULL").select("text_id", "start", "stop"))
    return found


#: What a comparing task gives out: repeated bytes (key null), or contexts of a group that is too large for one task.
OUT = "text_id long, start long, stop long, key long, l int, r int, gram long, ord long, place int, left binary, right binary"
_OUT = pa.schema([("text_id", LONG), ("start", LONG), ("stop", LONG), ("key", LONG), ("l", pa.int32()), ("r", pa.int32()), ("gram", LONG), ("ord", LONG), ("place", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])


def _repeated(ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.RecordBatch:
    data = [pa.array(ids, LONG), pa.array(starts, LONG), pa.array(stops, LONG)]
    return pa.RecordBatch.from_arrays([*data, *(pa.nulls(len(ids), f.type) for f in list(_OUT)[3:])], schema=_OUT)


def _deferred(rows: list[tuple], least: int) -> pa.RecordBatch:
    """Contexts of a large group under finer keys.

    All of a group share l bytes to the left and r to the right. Two of them that share ``least`` bytes share half of
    those that lack more on one side: each context goes on with that many more of its left bytes, and of its right ones.
    """
    out = []
    for _, l, r, gram, order, text, place, left, right, _ in rows:
        half = (least - l - r + 1) // 2
        for a, b in ((l + half, r), (l, r + half)):
            if len(left) >= a and len(right) >= b:
                out.append((text, None, None, string_id(b"%d,%d,%d:" % (gram, a, b) + left[:a] + right[:b]), a, b, gram, order, place, left, right))
    columns = zip(*out, strict=True) if out else [[] for _ in _OUT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT, strict=True)], schema=_OUT)


def _arrays(rows: list[tuple], least: int) -> tuple[np.ndarray, ...]:
    """gram, ord, text, place, left, n_left, right, n_right of contexts."""
    reach = least - ANCHOR
    gram, order, text, place = (np.array([x[i] for x in rows], np.int64) for i in (3, 4, 5, 6))
    n_left, n_right = np.array([len(x[7]) for x in rows], np.int64), np.array([len(x[8]) for x in rows], np.int64)
    left = np.frombuffer(b"".join(x[7].ljust(reach, b"\0") for x in rows), np.uint8).reshape(-1, reach) if reach else np.zeros((len(rows), 0), np.uint8)
    right = np.frombuffer(b"".join(x[8].ljust(least, b"\0") for x in rows), np.uint8).reshape(-1, least)
    return gram, order, text, place, left, n_left, right, n_right


def _lead(order: np.ndarray, text: np.ndarray, at: np.ndarray) -> int:
    """The place in the list of the first occurrence."""
    return int(np.lexsort((at, text, order))[0])


def _before(order: np.ndarray, text: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of ``a`` occurs before its partner in ``b``."""
    same_order, same_text = order[a] == order[b], text[a] == text[b]
    return (order[a] < order[b]) | (same_order & ((text[a] < text[b]) | (same_text & (place[a] < place[b]))))


def _compare(least: int):
    """Task over contexts sorted by key (l, r bytes are common to a key): repeated bytes, and what must be compared under finer keys.

    A group of more than CONTEXTS contexts is handed on instead of held. From the second round on rows are sorted by their
    bytes too, so equal contexts stand side by side and only the first of them is compared. Where l and r make up ``least``
    bytes the whole group is one repeat, and one pass with its first occurrence in hand is enough.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        late: list[tuple] = []
        plain: list[tuple[int, int, int]] = []  # repeated bytes found without a scan
        began, hot, before = 0, None, None
        leads: dict[bytes, tuple] = {}

        def flush() -> pa.RecordBatch:
            nonlocal began
            once = list({x[3:7]: x for x in rows}.values())  # repeated rows of the table
            gram, order, text, place, left, n_left, right, n_right = _arrays(once, least)
            rows.clear()
            began = 0
            entries, tree = intervals(gram, right, n_right)
            a, b, m, n = pairs(entries, tree, left, n_left, least)
            later = np.where(_before(order, text, place, a, b), b, a)
            held = [[text[later]], [place[later] - m], [place[later] + n]]
            size = 0
            for members, m, n in scan(entries, tree, left, n_left, least):
                at = place[members]
                rest = np.arange(len(members)) != _lead(order[members], text[members], at)
                members, at = members[rest], at[rest]
                for column, values in zip(held, (text[members], at - m, at + n), strict=True):
                    column.append(values)
                size += len(members)
                if size > 400_000:  # nested intervals name the same bytes again and again
                    held, size = [[x] for x in merged(*map(np.concatenate, held))], 0
            return _repeated(*merged(*map(np.concatenate, held)))

        def given() -> pa.RecordBatch:
            columns = np.array(plain, np.int64).T
            plain.clear()
            return _repeated(*merged(*columns))

        for batch in slices(batches, 8):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, l, r, _, order, text, place, left, right, again = row
                if len(plain) >= 50_000:
                    yield given()
                if again >= 0:
                    plain.append((text, place - (again >> 16), place + (again & 0xFFFF)))
                    continue
                if l + r > ANCHOR:  # sorted by context, then by order of occurrence
                    if before is not None and key == before[0] and left == before[7] and right == before[8]:
                        if row[4:7] != before[4:7]:
                            plain.append((text, place - len(left), place + len(right)))
                        continue
                    before = row
                if l + r >= least:
                    if leads and next(iter(leads.values()))[0] != key:
                        leads.clear()
                    window = left[:l] + b"|" + right[:r]
                    mine, lead = (key, order, text, place), leads.get(window)
                    if lead is None or mine < lead:
                        mine, leads[window] = lead, mine
                    if mine is not None:
                        plain.append((mine[2], mine[3] - l, mine[3] + r))
                    continue
                if key == hot:
                    late.append(row)
                    if len(late) >= 5_000:
                        yield _deferred(late, least)
                        late.clear()
                    continue
                if rows and key != rows[-1][0]:
                    if len(rows) >= CONTEXTS:
                        yield flush()
                    began = len(rows)
                rows.append(row)
                if len(rows) - began > CONTEXTS:
                    hot = key
                    late += rows[began:]
                    del rows[began:]
        if rows:
            yield flush()
        if late:
            yield _deferred(late, least)
        if plain:
            yield given()

    return run


#: Bytes of contexts that a task of ``maximal_repeats`` takes in hand at once, and how much wider each round reads.
WIDE, WIDER = 8 << 20, 4


def _wide_contexts(least: int, lower: int, wide: int):
    """Task over (ord, text, text_id, places, grams): up to ``wide`` bytes from each anchor on, and enough to its left. The key holds the first ``lower`` bytes, which are common to all that can still be alike."""
    reach = least - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for text, own, places, grams in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data, step = text.encode(), max(1, WIDE // (wide + reach))
                for at in range(0, len(places), step):
                    part = list(zip(places[at : at + step], grams[at : at + step], strict=True))
                    key = [string_id(b"%d:" % g + data[p : p + lower]) if lower > least else g for p, g in part]
                    left, right = [data[max(0, p - reach) : p][::-1] for p, _ in part], [data[p : p + wide] for p, _ in part]
                    yield pa.RecordBatch.from_arrays([pa.array(key, LONG), pa.array([own] * len(part), LONG), pa.array([p for p, _ in part], pa.int32()), pa.array([g for _, g in part], LONG), pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["key", "text_id", "place", "gram", "left", "right"])

    return run


def _padded(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bytes, and how many of them there are."""
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in data), np.uint8).reshape(-1, width), np.array([len(x) for x in data], np.int64)


def _maximal(least: int, wide: int):
    """Task over contexts sorted by key: all occurrences of maximal repeats, and (repeat null) the anchors whose repeats go on beyond ``wide`` bytes.

    A class of members that share as many bytes to the left as the contexts hold has an earlier anchor in common
    and is found from there. A class that shares more to the right than its interval is found in a deeper one.
    """
    reach = least - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal held
            part = list({x[:3]: x for x in rows}.values())
            rows.clear()
            held = 0
            key, text, place, gram = (np.array([x[i] for x in part], np.int64) for i in range(4))
            (left, n_left), (right, n_right) = _padded([x[4] for x in part], reach), _padded([x[5] for x in part], wide)
            order, tree = intervals(key, right, n_right)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            out: list[tuple] = []

            def put(members: np.ndarray, m: int, n: int) -> None:
                if m >= reach:
                    return
                if n == wide:
                    out.extend((None, None, int(text[i]), None, int(place[i]), int(gram[i])) for i in members)
                    return
                i = members[0]
                name = hashlib.blake2b(left[i, :m][::-1].tobytes() + right[i, :n].tobytes(), digest_size=16).hexdigest()
                out.extend((name, m + n, int(text[j]), int(place[j]) - m, None, None) for j in members)

            for a, b, m, n in zip(*pairs(order, tree, left, n_left, least), strict=True):
                put(np.array([a, b]), int(m), int(n))
            for members, m, n in scan(order, tree, left, n_left, least):
                ends = order[[rank[members].min(), rank[members].max()]]
                if _common(right[ends], n_right[ends])[0] == n:
                    put(members, m, n)
            columns = list(zip(*out, strict=True)) or [()] * len(_REPEATS)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _REPEATS, strict=True)], schema=_REPEATS)

        for batch in slices(batches, 5):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > WIDE and row[0] != rows[-1][0]:
                    yield flush()
                rows.append(row)
                held += wide + reach
        if rows:
            yield flush()

    return run


_REPEATS = pa.schema([("repeat", pa.string()), ("n_bytes", LONG), ("text_id", LONG), ("start", LONG), ("place", pa.int32()), ("gram", LONG)])


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, ord, text, id) of all rows, and (id, ord) of the first document of every different text.

    id is a 64-bit hash of the text. Of ten billion texts a few share one by chance: a second hash tells them apart, and
    they get ids of their own from both.
    """
    slim = docs.select(F.struct("*").alias(ROW), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("ord", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("id", text_hash(F.col("text")))
    keyed = slim.withColumn("other", F.xxhash64(F.lit(1), "text"))
    firsts = table(keyed.groupBy("id", "other").agg(F.min("ord").alias("ord")), "suffix-firsts")
    shared = firsts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    apart = table(firsts.join(shared, "id", "left_semi").select("id", "other", F.xxhash64(F.lit(2), "id", "other").alias("own")), "suffix-shared-ids")
    if apart.isEmpty():
        return slim, firsts.select("id", "ord")
    own = lambda df: df.join(apart, ["id", "other"], "left").withColumn("id", F.coalesce("own", "id")).drop("own", "other")
    return own(keyed).select(*slim.columns), own(firsts)


def _with_runs(docs: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """Adds first (false: an earlier document has the same text), starts and stops of the repeated bytes.

    Joined by text and document, so that a frequent text is no frequent key: what has no partner is a copy.
    """
    slim, firsts = _prepared(docs, id_col, text_col)
    runs = repeat_intervals(slim.select("ord", "text", "id"), firsts, least).groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("r"))
    plan = firsts.join(runs.withColumnRenamed("text_id", "id"), "id", "left").select("id", "ord", F.col("r.start").alias("starts"), F.col("r.stop").alias("stops"), F.lit(True).alias("first"))
    plan = table(plan, "suffix-runs")
    release(docs.sparkSession)
    return slim.join(plan, ["id", "ord"], "left")


def _spans(n: int, first: bool | None, starts: list[int] | None, stops: list[int] | None, least: int) -> list[tuple[int, int]]:
    """Maximal runs of repeated bytes of a text of n bytes, in order; touching runs are one."""
    if not first:
        return [(0, n)] if n >= least else []
    out: list[tuple[int, int]] = []
    for a, b in zip(starts or [], stops or [], strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def dedup_digests(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every whole text as UTF-8.

    Removed is each byte that lies in a string of ``least`` bytes which also starts earlier: in a document of
    smaller doc_id, or earlier in the same one; overlaps count, and strings are judged on the input. Null and
    empty texts have 0 bytes. Null ids come after all others and equal ids are not earlier than one another,
    so repeated rows are judged alike; an empty table gives no rows; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sizes, removed, spans, kept = [], [], [], []
            for text, first, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data = text.encode()
                cut = _spans(len(data), first, starts, stops, least)
                h, at = hashlib.sha256(), 0
                for a, b in cut:
                    h.update(data[at:a])
                    at = b
                h.update(data[at:])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                kept.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, LONG), pa.array(removed, LONG), pa.array(spans, LONG), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_runs(docs.select(id_col, text_col), least, id_col, text_col).select("doc_id", "text", "first", "starts", "stops")
    return rows.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs``, all their columns, with the repeated bytes of ``dedup_digests`` cut from the text.

    A removed run that begins or ends inside a character leaves that character whole. ``chars_col``, where
    there is such a column, becomes the new number of characters. Null texts stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            kept = []
            for text, first, starts, stops in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                data, at, parts = text.encode(), 0, []
                for a, b in _spans(len(data), first, starts, stops, least):
                    while a < len(data) and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b < len(data) and b > a and data[b] & 0xC0 == 0x80:
                        b -= 1
                    parts.append(data[at:a])
                    at = max(a, b)
                parts.append(data[at:])
                kept.append(b"".join(parts).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["whole", "kept"])

    found = _with_runs(docs, least, id_col, text_col).select(F.col(ROW).alias("whole"), "text", "first", "starts", "stops")
    out = found.mapInArrow(frugal(run), f"whole {found.schema['whole'].dataType.simpleString()}, kept string")
    columns = []
    for c in docs.columns:
        value = F.col("whole").getField(c)
        if c == text_col:
            value = F.when(value.isNotNull(), F.col("kept"))
        elif c == chars_col:
            value = F.when(F.col("whole").getField(text_col).isNotNull(), F.length("kept")).otherwise(value).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    return out.select(*columns)


def maximal_repeats(docs: DataFrame, least: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Maximal repeats of at least ``least`` bytes with all occurrences: repeat, n_bytes, doc_id, start, first.

    A repeat is a string of bytes that occurs twice or more, in one document or several, and whose occurrences are not
    all preceded by the same byte nor all followed by the same one. ``repeat`` is a 128-bit hash of it, ``first`` marks
    the occurrence of the smallest doc_id, then start; null ids come last. Rows with the same id and text are one document;
    null and empty texts have none; an empty table gives no rows.

    A round reads ``least`` bytes from each anchor on, the next four times as many from the anchors whose repeats go
    on, until none does. Different texts are compared once; copies of a text join as occurrences at the end. A task holds
    the contexts of one anchor that share the round's bytes: unlike ``dedup_digests``, it doesn't hand large groups on.
    """
    slim, firsts = _prepared(docs.select(id_col, text_col), id_col, text_col)
    slim = slim.select("ord", "text", "id", "doc_id")
    ship(docs.sparkSession)
    places, texts = _by_text(_repeated_anchors(slim, least)), slim.select("ord", "text", "id")
    lower, wide, found = least, least, None
    while True:
        contexts = _anchored(texts, firsts, places).mapInArrow(frugal(_wide_contexts(least, lower, wide)), "key long, text_id long, place int, gram long, left binary, right binary")
        dealt = contexts.repartition("key").sortWithinPartitions("key")
        out = table(dealt.mapInArrow(frugal(_maximal(least, wide)), "repeat string, n_bytes long, text_id long, start long, place int, gram long"), "suffix-repeats")
        closed = out.where("repeat IS NOT NULL").select("repeat", "n_bytes", "text_id", "start")
        found = closed if found is None else found.unionByName(closed)
        going_on = out.where("repeat IS NULL").select("text_id", "place", "gram")
        if going_on.isEmpty():
            break
        places, lower, wide = _by_text(going_on), wide, wide * WIDER

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [t.encode() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).hexdigest() for x in data], pa.string()), pa.array([len(x) for x in data], LONG), batch.column(1), pa.array([0] * len(data), LONG)], ["repeat", "n_bytes", "text_id", "start"])

    owners = slim.select(F.col("id").alias("text_id"), "ord", "doc_id").distinct()
    copied = owners.groupBy(F.col("text_id").alias("id")).agg(F.count("*").alias("n"), F.min("ord").alias("ord")).where("n > 1")
    copied = texts.join(copied.select("id", "ord"), ["id", "ord"], "left_semi").where(F.octet_length("text") >= least).select("text", F.col("id").alias("text_id"))
    found = found.unionByName(copied.mapInArrow(frugal(whole), closed.schema)).distinct()
    found = table(found.join(owners, "text_id"), "suffix-occurrences")
    lead = found.groupBy("repeat").agg(F.min(F.struct("ord", "text_id", "start")).alias("lead"))
    return found.join(lead, "repeat").select("repeat", "n_bytes", "doc_id", "start", (F.struct("ord", "text_id", "start") == F.col("lead")).alias("first"))
