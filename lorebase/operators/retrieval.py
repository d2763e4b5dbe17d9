"""R: retrieval of many queries at once. Candidates are a long table keyed by query_id; ties end at the smallest id."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from lorebase.functions.text import cosine, weighted_keywords
from lorebase.operators import blocks
from lorebase.operators.common import contains_pairs, first_texts, top
from lorebase.operators.tree import with_book
from lorebase.workers import stored

#: Weight of a channel in the fusion, and the fusion's constant.
WEIGHTS = {"vector": 1.0, "keyword": 1.0, "title": 1.0, "path": 0.8}
RRF_K = 60


def _by_dimension(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the unit vectors of the rows that have it and a length, and their places; from Arrow's flat values."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    out = {}
    for dim in np.unique(sizes[sizes > 0]).tolist():
        places = np.flatnonzero(sizes == dim)
        m = flat[starts[places][:, None] + np.arange(dim)]
        n = np.linalg.norm(m, axis=1)
        out[dim] = m[n > 0] / n[n > 0, None], places[n > 0]
    return out


def vector_search(queries: DataFrame, passages: DataFrame, k: int = 5, thr: float = 0.5, scope: DataFrame | None = None) -> DataFrame:
    """R2: query_id, id, similarity, rank of the k passages of cosine >= thr; queries(query_id, vec), passages(id, vec[, enabled]).

    Blocks of queries meet blocks of passages (``blocks.search``): the passages are read once whatever the number of queries,
    pairs never reach a shuffle, and a task passes on k rows per query. Vectors meet vectors of their own dimension.
    ``scope`` (query_id, id) restricts pairs.
    """
    p = passages.where("enabled") if "enabled" in passages.columns else passages
    if scope is not None:
        pairs = scope.join(queries.select("query_id", F.col("vec").alias("_q")), "query_id").join(p.select("id", F.col("vec").alias("_p")), "id")
        scored = pairs.select("query_id", "id", F.round(cosine(F.col("_q"), F.col("_p")), 6).alias("similarity")).where(F.col("similarity") >= thr)
        return top(scored, ["query_id"], [F.col("similarity").desc(), F.col("id")], k, "rank")
    q, p = queries.select("query_id", "vec").where("vec IS NOT NULL"), p.select("id", "vec").where("vec IS NOT NULL")
    kinds = [x.schema[c].dataType for x, c in ((q, "query_id"), (p, "id"))]
    shape = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double"
    found = blocks.search(q, p, lambda: _Nearest(k, thr, [to_arrow_type(x) for x in kinds]), shape)
    return top(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k, "rank")


class _Nearest(blocks.Kernel):
    """Cosines of unit vectors as matrix products."""

    def __init__(self, k: int, thr: float, kinds: list[pa.DataType]) -> None:
        self.k, self.thr, self.kinds = k, thr, kinds

    def prepare(self, queries: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return _by_dimension(queries.column(1))

    def found(self, asked: dict[int, tuple[np.ndarray, np.ndarray]], passages: pa.RecordBatch, floor: np.ndarray) -> list[np.ndarray]:
        ids, out = np.array(passages.column(0).to_pylist()), []
        for dim, (unit, at) in _by_dimension(passages.column(1)).items():
            if dim not in asked or not len(unit) or not len(asked[dim][0]):
                continue
            mine, places = asked[dim]
            sims = np.round(mine @ unit.T, 6)
            least = np.maximum(floor[places], self.thr)
            if sims.shape[1] > self.k:  # of a block only its own k best, and what ties with them
                least = np.maximum(least, -np.partition(-sims, self.k - 1, axis=1)[:, self.k - 1])
            i, j = np.nonzero(sims >= least[:, None])
            out.append((places[i], sims[i, j], ids[at[j]]))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0), ids[:0]]

    def best(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return blocks.best_rows(rows, self.k)

    def output(self, ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(rows[0])).cast(self.kinds[0]), pa.array(rows[2].tolist(), self.kinds[1]), pa.array(rows[1])], ["query_id", "id", "similarity"])


def with_titles(found: DataFrame, passages: DataFrame, docs: DataFrame) -> DataFrame:
    """R2: ``found`` rows (id) with the doc_id of their passage and the titles of its document and book; null where there is no document."""
    return with_book(found.join(passages.select("id", "doc_id"), "id", "left"), docs)


def vector_search_fallback(queries: DataFrame, passages: DataFrame, limit: int = 5, thr: float = 0.5, fallback: float = 0.4) -> DataFrame:
    """Limit + 2 rows at ``thr``; queries without any take those at ``fallback`` where that is lower."""
    found = vector_search(queries, passages, limit + 2, min(thr, fallback))
    best = F.max("similarity").over(Window.partitionBy("query_id"))
    return found.withColumn("_best", best).where((F.col("similarity") >= thr) | (F.col("_best") < thr)).drop("_best")


def keyword_search(queries: DataFrame, passages: DataFrame, limit: int = 10, most_terms: int = 20) -> DataFrame:
    """query_id, id, book, score, rank; queries(query_id, terms), passages(id, book, terms).

    Shared terms count 2 from three characters on, else 1; a score of 2 is needed; a book gives at most
    max(2, ceil(limit / 3)) rows. Blocks of queries, with a posting list of queries for each term, meet blocks of passages
    (``blocks.search``): a task keeps the best rows of each query, and the worst of a full list is the score that later
    passages must reach. A term that all texts share so costs additions in the tasks, no rows.
    """
    q = queries.select("query_id", F.array_compact(F.array_distinct(F.slice("terms", 1, most_terms))).alias("terms")).where(F.size("terms") > 0)
    p = passages.select("id", "book", F.array_compact(F.array_distinct("terms")).alias("terms")).where(F.size("terms") > 0)
    kinds = [x.schema[c].dataType for x, c in ((q, "query_id"), (p, "id"), (p, "book"))]
    shape = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, book {kinds[2].simpleString()}, score long"
    cap = max(2, -(-limit // 3))
    found = blocks.search(q, p, lambda: _Shared(limit, cap, [to_arrow_type(x) for x in kinds]), shape)
    order = [F.col("score").desc(), F.col("id")]
    return top(top(found, ["query_id", "book"], order, cap), ["query_id"], order, limit, "rank")


class _Shared(blocks.Kernel):
    """Sums of the weights of shared terms, from posting lists of the queries' terms."""

    #: Scores held at once: passages times queries.
    CELLS = 1 << 22

    def __init__(self, limit: int, cap: int, kinds: list[pa.DataType]) -> None:
        self.limit, self.cap, self.kinds = limit, cap, kinds
        self.books: dict[object, int] = {}

    def prepare(self, queries: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]:
        lists = queries.column(1)
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        term = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(term, kind="stable")
        edges = np.searchsorted(term[order], np.arange(len(coded.dictionary) + 1))
        weight = np.where(pa.compute.utf8_length(coded.dictionary).to_numpy(zero_copy_only=False) >= 3, 2, 1)
        return coded.dictionary, edges, owner[order], weight, len(lists)

    def found(self, asked: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int], passages: pa.RecordBatch, floor: np.ndarray) -> list[np.ndarray]:
        wanted, edges, owners, weight, n = asked
        lists = passages.column(2)
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = pa.compute.index_in(lists.flatten(), wanted)
        known = term.is_valid().to_numpy(zero_copy_only=False)
        row, term = row[known], term.drop_null().to_numpy(zero_copy_only=False)
        least, out = np.maximum(floor, 2), []
        step = max(1, self.CELLS // n)
        for a in range(0, len(lists), step):
            first, past = np.searchsorted(row, [a, a + step])
            r, t = row[first:past] - a, term[first:past]
            each = edges[t + 1] - edges[t]
            at = np.repeat(edges[t] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            score = np.bincount(np.repeat(r, each) * n + owners[at], np.repeat(weight[t], each), (min(a + step, len(lists)) - a) * n).reshape(-1, n)
            i, j = np.nonzero(score >= least)
            out.append((j, score[i, j], i + a))
        query, score, place = (np.concatenate(c) for c in zip(*out, strict=True))
        ids = np.array(passages.column(0).to_pylist())
        books = np.array([self.books.setdefault(b, len(self.books)) for b in passages.column(1).to_pylist()], np.int64)
        return [query, score, ids[place], books[place]]

    def best(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return blocks.best_rows(rows, self.limit, rows[3], self.cap)

    def output(self, ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        names = list(self.books)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(rows[0])).cast(self.kinds[0]), pa.array(rows[2].tolist(), self.kinds[1]), pa.array([names[b] for b in rows[3].tolist()], self.kinds[2]), pa.array(rows[1].astype(np.int64))], ["query_id", "id", "book", "score"]
        )


def cap_keywords(keywords: DataFrame) -> DataFrame:
    """K3: (query_id, n_chars, kw, weight): of questions over 30 characters all keywords of three characters and ten of two; then 25 by weight and length."""
    two = F.length("kw") == 2
    place = F.row_number().over(Window.partitionBy("query_id", two).orderBy(F.col("weight").desc(), "kw"))
    kept = keywords.withColumn("_n", place).where((F.col("n_chars") <= 30) | ~two | (F.col("_n") <= 10)).drop("_n")
    return top(kept, ["query_id"], [F.col("weight").desc(), F.length("kw").desc(), F.col("kw")], 25)


def extract_keywords(queries: DataFrame) -> DataFrame:
    """K2: query_id, n_chars, kw, weight (largest) of (query_id, text)."""
    out = queries.select("query_id", F.length("text").alias("n_chars"), F.explode(weighted_keywords(F.col("text"))).alias("k"))
    return out.groupBy("query_id", "n_chars", F.col("k.kw").alias("kw")).agg(F.max("k.weight").alias("weight"))


def keyword_search_ilike(keywords: DataFrame, passages: DataFrame, limit: int = 10, answered: DataFrame | None = None) -> DataFrame:
    """As R4 with score the summed weight of keywords contained in the content; for queries not in ``answered``."""
    kw = keywords if answered is None else keywords.join(answered.select("query_id").distinct(), "query_id", "left_anti")
    pairs = contains_pairs(passages, "content", kw.select("query_id", "kw", "weight"), "kw", ["id", "book"])
    scored = pairs.groupBy("query_id", "id", "book").agg(F.sum("weight").alias("score")).where("score >= 2")
    order = [F.col("score").desc(), F.col("id")]
    return top(top(scored, ["query_id", "book"], order, max(2, -(-limit // 3))), ["query_id"], order, limit, "rank")


def keyword_strict_relaxed(original: DataFrame, expanded: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """Passages with all original keywords; a query without such takes those with any expanded one, most first."""
    texts = passages.select("id", "content")
    n = original.select("query_id", "kw").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    strict = contains_pairs(texts, "content", original.select("query_id", "kw").distinct(), "kw", ["id"]).groupBy("query_id", "id").agg(F.countDistinct("kw").alias("score")).join(n, "query_id").where("score = n").select("query_id", "id", "score", F.lit("strict").alias("mode"))
    rest = expanded.join(strict.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "kw").distinct()
    relaxed = contains_pairs(texts, "content", rest, "kw", ["id"]).groupBy("query_id", "id").agg(F.countDistinct("kw").alias("score")).withColumn("mode", F.lit("relaxed"))
    return top(strict.unionByName(relaxed), ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank")


def title_search(keywords: DataFrame, docs: DataFrame, passages: DataFrame, k: int = 5) -> DataFrame:
    """Passages of the documents whose title contains a keyword of four characters (deepest first, 8 documents), else one of the first five keywords; else passages of the children of matched chapters."""
    titles = docs.select(F.col("id").alias("doc_id"), "title", "level")
    deepest = [F.col("level").desc(), F.col("doc_id")]
    sections = [(F.col("level") == 2).desc(), F.col("doc_id")]
    of = ["query_id", "doc_id", "level"]
    matched = first_texts(titles, "title", keywords.where(F.length("kw") >= 4).select("query_id", "kw"), "kw", ["doc_id", "level"], deepest, 8).select(*of).distinct()
    first = stored(top(matched, ["query_id"], deepest, 8), "title-first")
    few = top(keywords.join(first.select("query_id").distinct(), "query_id", "left_anti").where(F.length("kw") >= 2), ["query_id"], [F.col("weight").desc(), F.length("kw").desc(), F.col("kw")], 5)
    broad = first_texts(titles, "title", few.select("query_id", "kw"), "kw", ["doc_id", "level"], sections, 8).select(*of).distinct()
    hit = stored(first.unionByName(top(broad, ["query_id"], sections, 8)), "title-hits")
    # A query's first k passages are among the first k of one of its documents, or of one of its chapters.
    own_first = top(passages.select("id", "doc_id").distinct(), ["doc_id"], [F.col("id")], k)
    own = hit.join(own_first, "doc_id").select("query_id", "id", "doc_id")
    below = docs.where("parent_id IS NOT NULL").select(F.col("id").alias("child"), F.col("parent_id").alias("doc_id")).join(own_first.withColumnRenamed("doc_id", "child"), "child").distinct()
    under = hit.where("level = 1").join(own.select("query_id").distinct(), "query_id", "left_anti").join(top(below, ["doc_id"], [F.col("id")], k), "doc_id").select("query_id", "id", F.col("child").alias("doc_id"))
    return top(own.unionByName(under).distinct(), ["query_id"], [F.col("id")], k, "rank")


def section_path_search(keywords: DataFrame, passages: DataFrame, k: int = 10, first: int = 6) -> DataFrame:
    """Passages whose section_path contains any of the first keywords of three characters."""
    few = top(keywords.where(F.length("kw") >= 3), ["query_id"], [F.col("weight").desc(), F.length("kw").desc(), F.col("kw")], first)
    found = first_texts(passages, "section_path", few.select("query_id", "kw"), "kw", ["id"], [F.col("id")], k).select("query_id", "id").distinct()
    return top(found, ["query_id"], [F.col("id")], k, "rank")


def rrf_fuse(channels: DataFrame, k: int = RRF_K, weights: Mapping[str, float] | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(query_id, channel, rank, id) fused: id, score = sum of w / (k + rank) to 6 places, source, rank.

    A weight of 0 or less drops a channel, an unknown one weighs 1; ties go by the first channel's name, then its rank, id.
    """
    table = WEIGHTS if weights is None else weights
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("channel")), F.lit(1.0)) if table else F.lit(1.0)
    used = channels.withColumn("_w", w).where("_w > 0")
    fused = used.groupBy(*by, "id").agg(F.round(F.sum(F.col("_w") / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("channel", "rank")).alias("_first"), F.countDistinct("channel").alias("_n"))
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "_first", "id")
    return fused.select(*by, "id", "score", F.when(F.col("_n") > 1, "both").otherwise(F.col("_first.channel")).alias("source"), F.row_number().over(order).alias("rank"))


def book_quota(fused: DataFrame, limit: int = 5, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """At most max(2, ceil(limit / 2)) rows per book in fused order; an empty book is 其他."""
    book = F.coalesce(F.nullif(F.col("book"), F.lit("")), F.lit("其他"))
    place = F.row_number().over(Window.partitionBy(*by, book).orderBy("rank"))
    return fused.withColumn("_n", place).where(F.col("_n") <= max(2, -(-limit // 2))).drop("_n")


def prefix_dedup(ranked: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """In rank order, drops a row that shares over 60 % of the shorter text (10 characters or more) with a kept row's start.

    Two rows are alike if the start (60 % and a character) of one begins the start of the other. Of equal starts
    only the first row can stay; the distinct starts, sorted, are trees whose branches are rows next to one
    another, and a row stays if none below it ranks before it and no row above it is such a row. The starts are
    dealt out in ranges, so a long list, or a start that many texts share, is spread over the tasks; where a range begins comes from
    ``DRAWN_BYTES`` of starts, whatever their number. Starts are
    sorted once, without the texts; the rest runs on their hashes and depths, and texts are fetched for the rows that stay.
    """
    rows = ranked.withColumn("rank", F.col("rank").cast("int")).select(*by, "rank", "id", "content")
    length = F.length("content")
    start = F.left("content", F.floor(length * 6 / 10).cast("int") + 1)
    node = F.concat(F.to_json(F.struct(*by)), F.lit("\n"), start)
    key = F.when(length >= 10, F.sha2(node.cast("binary"), 256))
    first = rows.where(length >= 10).groupBy(key.alias("_key"), *by).agg(F.min(F.struct("rank", "id")).alias("_r"), F.any_value(node).alias("_node"))
    dealt = stored(first.select(*by, "_key", "_r.*", "_node"), "prefixes")
    walk = stored(_walk(dealt, _bounds(dealt)), "prefix-walk")
    late = walk.where("late").select("_key").distinct().withColumn("_late", F.lit(True))
    marked = walk.join(late, "_key", "left").withColumn("good", F.col("_late").isNull()).select("_part", "seq", "depth", "outer", "good", "_key")
    kept = dealt.select(*by, "rank", "id", "_key").join(_free(marked.repartition("_part").sortWithinPartitions("_part", "seq")), "_key", "left_semi")
    keyed = rows.withColumn("_key", key)
    same = [keyed[c].eqNullSafe(kept[c]) for c in (*by, "rank", "id", "_key")]
    long = keyed.where(length >= 10).join(kept, reduce(lambda x, y: x & y, same), "left_semi").dropDuplicates([*by, "rank", "id", "_key"])
    return keyed.where(F.coalesce(length < 10, F.lit(True))).unionByName(long).select(*rows.columns)


#: Bytes of starts that come to the driver to find where ranges begin. Spark's own ranges draw 300 rows for each partition, of starts as long as half a text.
DRAWN_BYTES = 8 << 20


def _bounds(starts: DataFrame) -> list[str]:
    """Sorted starts (_node, _key) that part the table in a range for each shuffle partition, from about ``DRAWN_BYTES`` of them drawn by their hashes."""
    size = starts.agg(F.sum(F.octet_length("_node"))).first()[0] or 0
    share = int((1 << 30) * min(1, DRAWN_BYTES / max(1, size)))
    drawn = sorted(r["_node"] for r in starts.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < share).select("_node").collect())
    n = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted({drawn[i * len(drawn) // n] for i in range(1, n)}) if drawn else []


def _walk(dealt: DataFrame, bounds: list[str]) -> DataFrame:
    """The trees of starts as a walk: _part, seq, depth, _key, outer, late (whether a row below it in the range ranks before it).

    ``dealt`` is split at ``bounds`` in ranges (_part) and sorted. What begins a row and lies in an earlier range begins the
    bound of the row's own range too: these few, at most one for each length, are found first, sent to the
    tasks as lengths, and open the walk of the range as outer rows.
    """
    spark = dealt.sparkSession
    slim = dealt.select("_node", "_key", "rank", "id")
    place_of = lambda rank, i: (rank is not None, rank, i is not None, i)  # noqa: E731  # nulls first
    names = spark.sparkContext.broadcast(bounds)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [bisect_right(names.value, node) for node in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *batch.columns], ["_part", *batch.schema.names])

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = names.value
        for batch in batches:
            found, parts = [], []
            for i, node in enumerate(batch.column(0).to_pylist()):
                j = bisect_right(nodes, node)
                while j < len(nodes) and nodes[j].startswith(node):
                    found.append(i)
                    parts.append((j + 1, len(node)))
                    j += 1
            if found:
                rows = batch.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in zip(*parts, strict=True)), *rows.columns[1:]], ["_part", "size", *rows.schema.names[1:]])

    above: dict[int, list[tuple]] = {}
    kinds = slim.schema.fields
    for r in slim.mapInArrow(outer, StructType([StructField("_part", IntegerType()), StructField("size", IntegerType()), *kinds[1:]])).collect():  # what begins a bound
        above.setdefault(r["_part"], []).append((r["size"], r["_key"], place_of(r["rank"], r["id"])))
    opened = spark.sparkContext.broadcast({k: sorted(v, key=lambda x: x[0]) for k, v in above.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # node, key, place, first place below, part, seq, outer
        now, seq = None, 0
        out: list[tuple] = []

        def close() -> None:
            node, key, place, below, part, at, out_of = stack.pop()
            out.append((part, at, len(stack), key, out_of, below is not None and below < place))
            if stack:
                least = place if below is None else min(place, below)
                stack[-1][3] = least if stack[-1][3] is None else min(stack[-1][3], least)

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], ["_part", "seq", "depth", "_key", "outer", "late"])

        for batch in batches:
            part, nodes, keys, ranks, ids = (c.to_pylist() for c in batch.columns)
            for i, node in enumerate(nodes):
                if part[i] != now:
                    while stack:
                        close()
                    now, seq = part[i], 0
                    for n, k, p in opened.value.get(now, []):
                        stack.append([names.value[now - 1][:n], k, p, None, now, seq, True])
                        seq += 1
                while stack and not node.startswith(stack[-1][0]):
                    close()
                stack.append([node, keys[i], place_of(ranks[i], ids[i]), None, now, seq, False])
                seq += 1
            yield rows()
        while stack:
            close()
        yield rows()

    ranges = slim.mapInArrow(part, StructType([StructField("_part", IntegerType()), *kinds])).repartition("_part").sortWithinPartitions("_part", "_node")
    return ranges.mapInArrow(run, "_part int, seq long, depth int, _key string, outer boolean, late boolean")


def _free(walk: DataFrame) -> DataFrame:
    """_key of the good rows of a walk (_part, seq, depth, outer, good, _key) that have no good row above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path = None, []
        for batch in batches:
            part, _, depth, outer, good, keys = (c.to_pylist() for c in batch.columns)
            kept = []
            for i, d in enumerate(depth):
                if part[i] != now:
                    now, path = part[i], []
                del path[d:]
                above = bool(path) and path[-1]
                path.append(above or good[i])
                if good[i] and not above and not outer[i]:
                    kept.append(keys[i])
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["_key"])

    return walk.mapInArrow(run, "_key string")


def hybrid_search(queries: DataFrame, passages: DataFrame, docs: DataFrame, limit: int = 5, thr: float = 0.5, most: int | None = 20, vectors: DataFrame | None = None) -> DataFrame:
    """Vector, keyword and title channels fused, capped per book, deduplicated; queries with under three rows add the path channel.

    queries(query_id, text, vec, terms); passages(id, doc_id, book, content, section_path, vec, terms). Returns query_id, rank, id,
    score, source, book and content, the first ``most`` rows of a query or all (None). Vectors may come apart, as ``vectors`` (id, vec) of these
    passages, so that no text goes through their join. The channels are searched once; texts are only fetched for what the quota left. Every
    step is written, so that no plan holds the steps before it: their plans and metrics stay on the driver.
    """
    kw = stored(cap_keywords(extract_keywords(queries)), "keywords")
    channel = lambda df, name: df.select("query_id", F.lit(name).alias("channel"), "rank", "id")
    base = channel(vector_search_fallback(queries, passages if vectors is None else vectors, limit, thr), "vector").unionByName(channel(keyword_search(queries, passages, limit * 3), "keyword")).unionByName(channel(title_search(kw, docs, passages, limit), "title"))
    base = stored(base, "channels")
    texts = passages.select("id", "book", "content")

    def finish(channels: DataFrame) -> DataFrame:
        ranked = stored(book_quota(rrf_fuse(channels).join(texts.select("id", "book"), "id"), limit), "fused")
        held = stored(ranked.join(texts.select("id", "content"), "id").select("query_id", "rank", "id", "content"), "fused-texts")
        return stored(ranked.join(prefix_dedup(held).select("query_id", "id"), ["query_id", "id"], "left_semi"), "deduplicated")

    first = finish(base)
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 3")
    few = queries.where(F.length("text") > 5).join(enough, "query_id", "left_anti").select("query_id")
    path = stored(section_path_search(kw.join(few, "query_id", "left_semi"), passages, limit * 2), "path")
    again = path.select("query_id").distinct()
    second = finish(base.join(again, "query_id", "left_semi").unionByName(channel(path, "path")))
    found = first.join(again, "query_id", "left_anti").unionByName(second)
    found = found if most is None else top(found, ["query_id"], [F.col("rank")], most)
    return found.join(texts.select("id", "content"), "id").select("query_id", "rank", "id", "score", "source", "book", "content")


def apply_rerank(candidates: DataFrame, judgments: DataFrame, keywords: DataFrame | None = None, first: int = 8, min_level: int = 1) -> DataFrame:
    """The first candidates of each query (query_id, rank, id, content) with a level, those kept in their order, and the query's number of level 2.

    ``judgments`` (query_id, json): {"judgments": [{id, level}]} or {"keep": [ids]}, id the candidate's place;
    other text around the braces, unknown ids and levels are ignored; level 2 by default. Level 0 with two
    keywords contained becomes 1. Two candidates or fewer pass as they are.
    """
    shape = "judgments array<struct<id:int,level:int>>, keep array<int>"
    parsed = judgments.select("query_id", F.from_json(F.regexp_extract("json", r"(?s)(\{.*\})", 1), shape).alias("j"))
    levels = parsed.select("query_id", F.explode("j.judgments").alias("x")).select("query_id", F.col("x.id").alias("rank"), F.col("x.level").alias("said")).where("said IN (0, 1, 2)").groupBy("query_id", "rank").agg(F.max("said").alias("said"))
    few = candidates.where(F.col("rank") <= first).withColumn("_n", F.count("*").over(Window.partitionBy("query_id")))
    out = few.join(levels, ["query_id", "rank"], "left").withColumn("level", F.when(F.col("_n") <= 2, 2).otherwise(F.coalesce("said", F.lit(2))))
    if keywords is not None:
        words = keywords.groupBy("query_id").agg(F.collect_set("kw").alias("_kw"))
        hits = F.size(F.filter(F.coalesce("_kw", F.array().cast("array<string>")), lambda w: F.contains(F.col("content"), w)))
        out = out.join(words, "query_id", "left").withColumn("level", F.when((F.col("level") == 0) & (hits >= 2), 1).otherwise(F.col("level"))).drop("_kw")
    n2 = F.sum((F.col("level") == 2).cast("int")).over(Window.partitionBy("query_id"))
    return out.withColumn("level2", n2).where(F.col("level") >= min_level).drop("_n", "said")


def ensure_book_coverage(kept: DataFrame, candidates: DataFrame, limit: int, evaluated: int = 8) -> DataFrame:
    """Kept rows, then for each book without one its best candidate ranked after the evaluated ones, until ``limit``."""
    later = candidates.where(F.col("rank") > evaluated).join(kept.select("query_id", "book").distinct(), ["query_id", "book"], "left_anti")
    best = top(later, ["query_id", "book"], [F.col("rank"), F.col("id")], 1)
    both = kept.select("query_id", "rank", "id", "book").withColumn("_added", F.lit(0)).unionByName(best.select("query_id", "rank", "id", "book").withColumn("_added", F.lit(1)))
    return top(both, ["query_id"], [F.col("_added"), F.col("rank"), F.col("id")], limit, "place").withColumnRenamed("_added", "added")


def weak_hits(queries: DataFrame, reranked: DataFrame) -> DataFrame:
    """query_id and label: no_result without candidates, weak_hit without level 2, else ok."""
    n = reranked.groupBy("query_id").agg(F.count("*").alias("n"), F.sum((F.col("level") == 2).cast("int")).alias("n2"))
    label = F.when(F.col("n").isNull(), "no_result").when(F.col("n2") == 0, "weak_hit").otherwise("ok")
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", label.alias("label"))


def page_route(codes: DataFrame, rule_map: DataFrame) -> DataFrame:
    """Code, matched, doc_ids, passage_ids: enabled documents of the code by relevance, or of its nearest parent (last ``.xxx`` off); nulls without any."""
    parts = F.split("code", r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, (F.size(parts) - i).cast("int")), ".").alias("prefix")))
    up = codes.select("code").distinct().select("code", F.inline(prefixes))
    found = up.join(rule_map.where("enabled").withColumnRenamed("note_qc_code", "prefix"), "prefix")
    found = found.withColumn("_least", F.min("depth").over(Window.partitionBy("code"))).where("depth = _least")
    rows = F.sort_array(F.collect_list(F.struct((-F.col("relevance")).alias("r"), "doc_id", "passage_ids")))
    out = found.groupBy("code", F.col("prefix").alias("matched")).agg(rows.alias("rows"))
    out = out.select("code", "matched", F.array_distinct(F.col("rows.doc_id")).alias("doc_ids"), F.array_distinct(F.flatten(F.col("rows.passage_ids"))).alias("passage_ids"))
    return codes.select("code").distinct().join(out, "code", "left")


def scoped_search(queries: DataFrame, passages: DataFrame, limit: int = 3, thr: float = 0.5) -> DataFrame:
    """Cosine search inside the query's passage_ids, without a row there inside its doc_ids; limit times its documents rows.

    queries(query_id, vec, doc_ids, passage_ids); passages(id, doc_id, vec). No scope, no rows.
    """
    inside = queries.select("query_id", "vec", F.explode("passage_ids").alias("id")).join(passages.select("id", "doc_id", F.col("vec").alias("_p")), "id")
    inside = inside.select("query_id", "id", "doc_id", F.round(cosine(F.col("vec"), F.col("_p")), 6).alias("similarity")).where(F.col("similarity") >= thr)
    inside = stored(inside.distinct(), "scoped")
    # Documents are searched only for the queries that found nothing inside their passages.
    rest = queries.join(inside.select("query_id").distinct(), "query_id", "left_anti")
    most = queries.select("query_id", (F.lit(limit) * F.greatest(F.lit(1), F.size("doc_ids"))).alias("_most"))
    k = most.agg(F.max("_most")).first()[0] or limit
    docs = grouped_search(rest.select("query_id", "vec", F.col("doc_ids").alias("groups")), passages.select("id", "vec", F.col("doc_id").alias("group")).distinct(), k, thr)
    both = inside.unionByName(docs.withColumnRenamed("group", "doc_id").distinct())
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))
    return both.withColumn("rank", place).join(most, "query_id").where("rank <= _most").drop("_most")


def grouped_search(queries: DataFrame, passages: DataFrame, k: int, thr: float) -> DataFrame:
    """query_id, id, similarity, group: at least each query's k nearest passages (id, vec, group) of its groups with cosine >= thr; queries(query_id, vec, groups).

    Blocks of queries meet blocks of passages as in ``vector_search``; only vectors of a common group are multiplied, and no pair is shuffled but the
    tasks' best. At a ``thr`` of 0 or less pairs without a cosine count as 0, which takes a join.
    """
    q = queries.where("vec IS NOT NULL").select("query_id", "vec", F.array_compact(F.array_distinct("groups")).alias("groups"))
    if thr <= 0:
        pairs = queries.select("query_id", F.col("vec").alias("_q"), F.explode(F.array_distinct("groups")).alias("group")).join(passages, "group")
        return pairs.select("query_id", "id", F.round(cosine(F.col("_q"), F.col("vec")), 6).alias("similarity"), "group").where(F.col("similarity") >= thr)
    p = passages.where("vec IS NOT NULL AND group IS NOT NULL").select("id", "vec", "group")
    kinds = [x.schema[c].dataType for x, c in ((q, "query_id"), (p, "id"), (p, "group"))]
    shape = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, similarity double, group {kinds[2].simpleString()}"
    return blocks.search(q, p, lambda: _InGroups(k, thr, [to_arrow_type(x) for x in kinds]), shape)


class _InGroups(_Nearest):
    """Cosines of the vectors that share a group, a product for each group of a block."""

    def __init__(self, k: int, thr: float, kinds: list[pa.DataType]) -> None:
        super().__init__(k, thr, kinds)
        self.groups: dict[object, int] = {}

    def prepare(self, queries: pa.RecordBatch) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[object, np.ndarray]]:
        members: dict[object, list[int]] = {}
        for i, groups in enumerate(queries.column(2).to_pylist()):
            for g in groups or ():
                members.setdefault(g, []).append(i)
        return _by_dimension(queries.column(1)), {g: np.array(v) for g, v in members.items()}

    def found(self, asked: tuple[dict[int, tuple[np.ndarray, np.ndarray]], dict[object, np.ndarray]], passages: pa.RecordBatch, floor: np.ndarray) -> list[np.ndarray]:
        units, members = asked
        ids, out = np.array(passages.column(0).to_pylist()), []
        coded = passages.column(2).dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
        for dim, (unit, at) in _by_dimension(passages.column(1)).items():
            if dim not in units:
                continue
            mine, places = units[dim]
            row = np.full(len(floor), -1)
            row[places] = np.arange(len(places))
            order = np.argsort(code[at], kind="stable")
            edges = np.searchsorted(code[at][order], np.arange(len(names) + 1))
            for c, name in enumerate(names):
                q, p = row[members[name]] if name in members else row[:0], order[edges[c] : edges[c + 1]]
                q = q[q >= 0]
                if not len(q) or not len(p):
                    continue
                sims = np.round(mine[q] @ unit[p].T, 6)
                i, j = np.nonzero(sims >= np.maximum(floor[places[q]], self.thr)[:, None])
                out.append((places[q[i]], sims[i, j], ids[at[p[j]]], np.full(len(i), self.groups.setdefault(name, len(self.groups)))))
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0), ids[:0], np.zeros(0, np.int64)]

    def output(self, ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        names = list(self.groups)
        plain = super().output(ids, rows)
        return pa.RecordBatch.from_arrays([*plain.columns, pa.array([names[g] for g in rows[3].tolist()], self.kinds[2])], [*plain.schema.names, "group"])


def verify_search(queries: DataFrame, verify: DataFrame, k: int = 3, thr: float = 0.5) -> DataFrame:
    """Enabled sentences (id, note_qc_code, vec) of the query's rule code with cosine >= thr, the k nearest."""
    v = (verify.where("enabled") if "enabled" in verify.columns else verify).select("id", "vec", F.col("note_qc_code").alias("group"))
    found = grouped_search(queries.select("query_id", "vec", F.array("note_qc_code").alias("groups")), v, k, thr).drop("group")
    return top(found, ["query_id"], [F.col("similarity").desc(), F.col("id")], k, "rank")


def merge_per_book(rows: DataFrame, limit: int) -> DataFrame:
    """Best row of each document first (rows without one stand alone), the rest by similarity; max(limit, documents) rows, then by similarity."""
    group = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("id").cast("string")))
    best = F.row_number().over(Window.partitionBy("query_id", group).orderBy(F.col("similarity").desc(), "id")) == 1
    out = rows.withColumn("_rep", best)
    n = F.sum(F.col("_rep").cast("int")).over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("_rep").desc(), F.col("similarity").desc(), "id"))
    out = out.withColumn("_n", n).withColumn("_place", place).where(F.col("_place") <= F.greatest(F.lit(limit), F.col("_n")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id"))).drop("_rep", "_n", "_place")


def coarse_books(keywords: DataFrame, docs: DataFrame, systems: DataFrame | None = None, authority: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Books by keyword hits: 2 in a book's title, domain or keywords, 1 in a chapter's, 3 in a section's title, 2 per chapter of a matched body system (query_id, domain); times authority.

    keywords(query_id, kw), repeated ones count again; docs(id, title, domain, level, parent_id[, keywords]).
    """
    own = [F.when(F.col("level") == 0, F.array_join("keywords", " "))] if "keywords" in docs.columns else []
    book = docs.select("id", F.coalesce("parent_id", F.lit(-1)).alias("_p"), "level", F.concat_ws(" ", "title", "domain", *own).alias("both"), "title", "domain")
    up = docs.select(F.col("id").alias("_p"), F.col("parent_id").alias("_pp"))
    of = book.join(up, "_p", "left").withColumn("book_id", F.when(F.col("level") == 0, F.col("id")).when(F.col("level") == 1, F.col("_p")).otherwise(F.col("_pp")))
    searched = of.withColumn("text", F.when(F.col("level") == 2, F.col("title")).otherwise(F.col("both"))).withColumn("points", F.when(F.col("level") == 0, 2).when(F.col("level") == 1, 1).otherwise(3))
    points = contains_pairs(searched, "text", keywords.select("query_id", "kw"), "kw", ["id", "book_id", "points"]).select("query_id", "book_id", "points")
    if systems is not None:
        points = points.unionByName(of.where("level = 1").join(systems.select("query_id", "domain").distinct(), "domain").select("query_id", "book_id", F.lit(2).alias("points")))
    total = points.groupBy("query_id", "book_id").agg(F.sum("points").cast("double").alias("score"))
    if authority is not None:
        total = total.join(authority, "book_id", "left").withColumn("score", F.col("score") * F.coalesce("authority", F.lit(1.0))).drop("authority")
    return top(total.where("score > 0"), ["query_id"], [F.col("score").desc(), F.col("book_id")], k, "rank")


def route_writeback(routes: DataFrame, passages: DataFrame, rule_map: DataFrame) -> DataFrame:
    """New (note_qc_code, doc_id, relevance 2) of learned routes (code, doc_id, keywords) that a keyword of the first eight confirms in the document's first three passages."""
    three = top(passages, ["doc_id"], [F.col("id")], 3).groupBy("doc_id").agg(F.collect_list("content").alias("_texts"))
    words = F.slice(F.array_distinct("keywords"), 1, 8)
    sure = F.exists(words, lambda w: F.exists(F.col("_texts"), lambda t: F.contains(t, w)))
    new = routes.join(three, "doc_id").where(sure).select(F.col("code").alias("note_qc_code"), "doc_id").distinct()
    return new.join(rule_map.select("note_qc_code", "doc_id"), ["note_qc_code", "doc_id"], "left_anti").withColumn("relevance", F.lit(2))


def degrade_chain(queries: DataFrame, stages: Sequence[tuple[str, DataFrame | Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Each query's rows (query_id, id, rank) of the first stage that has any, with the stage's name.

    A stage is its rows, or a function of the queries that are still without one, so that a dear search runs for those alone.
    """
    found, rest = None, queries
    for name, stage in stages:
        rows = (stage(rest) if callable(stage) else stage).join(rest.select("query_id").distinct(), "query_id", "left_semi")
        rows = stored(rows.select("query_id", "id", "rank", F.lit(name).alias("stage")), "stage")
        found = rows if found is None else found.unionByName(rows)
        rest = rest.join(rows.select("query_id").distinct(), "query_id", "left_anti")
    return found


def low_similarity_alerts(queries: DataFrame, rows: DataFrame, thr: float = 0.55) -> DataFrame:
    """Queries without a row or with a best similarity below ``thr``."""
    best = rows.groupBy("query_id").agg(F.max("similarity").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").where(F.col("best").isNull() | (F.col("best") < thr))


def second_stage_rerank(candidates: DataFrame, k: int = 3, low: float = 0.3) -> DataFrame:
    """Candidates (query_id, id, qvec, tvec) by the cosine of their second vectors, k each; flag ``weak`` where the best is below ``low``."""
    scored = candidates.select("query_id", "id", F.round(cosine(F.col("qvec"), F.col("tvec")), 6).alias("similarity"))
    weak = F.max("similarity").over(Window.partitionBy("query_id")) < low
    return top(scored.withColumn("weak", weak), ["query_id"], [F.col("similarity").desc(), F.col("id")], k, "rank")


def numbered_context(candidates: DataFrame, sep: str = "\n\n---\n\n") -> DataFrame:
    """query_id and its sources as one text: 【参考n】《title》 section, then the content."""
    line = F.concat(F.lit("【参考"), F.col("rank").cast("string"), F.lit("】《"), "title", F.lit("》"), F.when(F.length("section") > 0, F.concat(F.lit(" "), F.col("section"))).otherwise(""), F.lit("\n"), "content")
    rows = F.sort_array(F.collect_list(F.struct("rank", line.alias("line"))))
    return candidates.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), sep).alias("context"))


def expand_synonyms(keywords: DataFrame, synonyms: DataFrame) -> DataFrame:
    """K5: query_id, kw, canonical_name, added: the keyword's other names from the first entry (by canonical_name, then synonyms) it equals, is part of, or contains, any case.

    Both directions of containment go through ``contains_pairs``.
    """
    s = synonyms.where("enabled") if "enabled" in synonyms.columns else synonyms
    names = s.select("canonical_name", "synonyms", F.explode(F.concat(F.array("canonical_name"), "synonyms")).alias("name"))
    k = keywords.select("query_id", "kw")
    longer = contains_pairs(k, "kw", names, "name", ["query_id", "kw"]).select("query_id", "kw", "canonical_name", "synonyms")
    shorter = contains_pairs(names, "name", k, "kw", ["canonical_name", "synonyms"]).select("query_id", "kw", "canonical_name", "synonyms")
    first = top(longer.unionByName(shorter).distinct(), ["query_id", "kw"], [F.col("canonical_name"), F.col("synonyms")], 1)
    return first.select("query_id", "kw", "canonical_name", F.filter("synonyms", lambda x: F.lower(x) != F.lower(F.col("kw"))).alias("added"))


def lookup_icd(queries: DataFrame, icd: DataFrame, most: int = 20) -> DataFrame:
    """K9: query_id, systems (all body systems, sorted) and codes (first 20 by code) whose code, or a search word of two characters, the question contains."""
    on = icd.where("enabled") if "enabled" in icd.columns else icd
    words = on.select("icd_code", "body_system", F.explode(F.array_distinct(F.concat(F.array("icd_code"), F.filter(F.split("search_text", r"\s+"), lambda w: F.length(w) >= 2)))).alias("word"))
    words = stored(words.select("icd_code", "body_system", F.lower("word").alias("word")).distinct(), "icd-words")
    hit = stored(contains_pairs(queries, "text", words.select("word").distinct(), "word", ["query_id"]).distinct(), "icd-hits")
    # Entries of one word are many; a query needs their distinct systems and the first codes of each word.
    codes = top(words.select("word", "icd_code").where("icd_code IS NOT NULL").distinct(), ["word"], [F.col("icd_code")], most)
    listed = hit.join(codes, "word").select("query_id", F.lit(None).cast(words.schema["body_system"].dataType).alias("body_system"), "icd_code")
    found = hit.join(words.select("word", "body_system").distinct(), "word").select("query_id", "body_system").distinct()
    rows = found.withColumn("icd_code", F.lit(None).cast(words.schema["icd_code"].dataType)).unionByName(listed)
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_set("body_system")).alias("systems"), F.slice(F.sort_array(F.collect_set("icd_code")), 1, most).alias("codes"))
