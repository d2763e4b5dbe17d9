"""G: knowledge graph. entities(id, name, entity_type, confidence, enabled, vec, doc_id), edges(id, source_id, target_id, relation_type)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorebase.operators.common import PART_BYTES, numbered, part_numbers, small, top
from lorebase.operators.retrieval import vector_search
from lorebase.workers import ship, stored

# Weight of a relation, and of one not listed.
RELATION_WEIGHTS = {"confirms_diagnosis": 1.0, "treated_by": 0.9, "supports_diagnosis": 0.7, "indicates": 0.5, "risk_factor_for": 0.4, "accompanied_by": 0.3}
OTHER_WEIGHT = 0.5


def seed_entities(queries: DataFrame, entities: DataFrame, rule_map: DataFrame, thr: float = 0.5, min_conf: float = 0.5, types: list[str] | None = None) -> DataFrame:
    """G1: query_id, id, source: entities mapped to the query's rule (20 by relevance), then the 10 nearest by vector; each once, rule first."""
    mapped = queries.select("query_id", "note_qc_code").join(rule_map.where("enabled"), "note_qc_code")
    by_rule = top(mapped, ["query_id"], [F.col("relevance").desc(), F.col("entity_id")], 20).select("query_id", F.col("entity_id").alias("id"), F.lit("rule").alias("source"))
    fit = entities.where(F.col("enabled") & (F.col("confidence") >= min_conf))
    fit = fit.where(F.col("entity_type").isin(*types)) if types else fit
    near = vector_search(queries, fit, 10, thr).select("query_id", "id", F.lit("vector").alias("source"))
    return by_rule.unionByName(near).groupBy("query_id", "id").agg(F.min("source").alias("source"))


def k_hop(seeds: DataFrame, edges: DataFrame, hops: int = 2, cap: int = 30, only_enabled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, hop) of visited nodes and (query_id, edge, hop) of edges touched, breadth first over both directions.

    Each hop is written to the shared folder. A hop adds at most ``cap`` nodes per query, by the smallest edge id and the source before the target. Of a
    node's neighbours, in this order, only so many can be among them as a query may have visited and ``cap`` more: what comes later has ``cap``
    new ones before it at that node already. A hub so gives this many rows to a query, and all its edges only to ``touched``.
    """
    e = edges.where("enabled") if only_enabled else edges
    e = stored(e.select("id", "source_id", "target_id"), "edges")
    both = ways(e.withColumnRenamed("id", "edge"))
    nodes = seeds.select("query_id", "id", F.lit(0).alias("hop")).distinct()
    most = nodes.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    frontier = nodes
    for hop in range(1, hops + 1):
        near = both.join(small(frontier.select("id").distinct()), "id", "left_semi").repartition("id").groupBy("id", "to").agg(F.min(F.struct("edge", "side")).alias("_first"))
        near = top(near, ["id"], [F.col("_first"), F.col("to")], most + cap * hop)
        step = frontier.select("query_id", "id").join(near, "id").select("query_id", F.col("to").alias("id"), "_first")
        new = step.join(nodes.select("query_id", "id"), ["query_id", "id"], "left_anti").groupBy("query_id", "id").agg(F.min("_first").alias("_first"))
        frontier = stored(top(new, ["query_id"], [F.col("_first"), F.col("id")], cap).select("query_id", "id", F.lit(hop).alias("hop")), "k-hop")
        nodes = nodes.unionByName(frontier)
    found = touched(nodes.where(F.col("hop") < hops), e.withColumnRenamed("id", "edge"))
    return nodes, found


def ways(edges: DataFrame) -> DataFrame:
    """Both directions of edges (edge, source_id, target_id, more): id and to in place of the ends, and side (1 from the source)."""
    more = [c for c in edges.columns if c not in ("source_id", "target_id")]
    way = lambda a, b, side: F.struct(F.col(a).alias("id"), F.col(b).alias("to"), F.lit(side).alias("side"))
    return edges.select(*more, F.inline(F.array(way("source_id", "target_id", 1), way("target_id", "source_id", 0))))


#: Walked nodes of a query up to which each of them carries the list.
WALKED = 1000


def touched(walked: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, edge and least hop of the edges (edge, source_id, target_id) at walked nodes (query_id, id, hop), each once.

    An edge comes twice only from its two ends, so the end that the query walked first keeps it: a walked node carries the query's list, and
    the edges are not shuffled to be made distinct. That is left to edge ids with several pairs of ends, and to queries of more than ``WALKED`` nodes.
    """
    ends = edges.select("edge", F.struct("source_id", "target_id").alias("_ends"))
    per = ends.groupBy("edge").agg(F.min("_ends").alias("_a"), F.max("_ends").alias("_b"))
    several = per.where("NOT _a <=> _b").select(F.col("edge").alias("_edge"))
    plain = per.where("_a <=> _b").select("edge", "_a.*")
    size = walked.groupBy("query_id").agg(F.count("*").alias("_n"))
    few = walked.join(size.where(F.col("_n") <= WALKED), "query_id").drop("_n")
    many = walked.join(few.select("query_id").distinct(), "query_id", "left_anti")
    once = from_first_end(few, ways(plain)).select("query_id", "edge", "hop")
    return once.unionByName(least_hops(few, many, edges, several))


def from_first_end(few: DataFrame, at: DataFrame) -> DataFrame:
    """The walked nodes joined with ``ways`` at them, hop one more, each edge of a query from the end that it walked first."""
    lists = few.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "id"))), lambda x: x["id"]).alias("_walked"))
    carried = few.join(lists, "query_id").withColumn("_own", F.array_position("_walked", F.col("id")))
    step = carried.join(at, "id")
    other = F.coalesce(F.array_position("_walked", F.col("to")), F.lit(0))
    first = (other == 0) | (other > F.col("_own")) | ((other == F.col("_own")) & (F.col("side") == 0))
    return step.where(first).withColumn("hop", F.col("hop") + 1)


def least_hops(few: DataFrame, many: DataFrame, edges: DataFrame, several: DataFrame) -> DataFrame:
    """query_id, edge and least hop, made distinct: of edge ids with several pairs of ends, and of all edges of the queries ``many``."""
    shared = edges.join(several, F.col("edge").eqNullSafe(F.col("_edge")), "left_semi")
    rest = few.join(ways(shared), "id").select("query_id", "edge", "hop").unionByName(many.join(ways(edges), "id").select("query_id", "edge", "hop"))
    return rest.groupBy("query_id", "edge").agg((F.min("hop") + 1).alias("hop"))


#: Bytes of walked nodes up to which every task gets them all.
NODE_BYTES = 8 << 20


def touched_named(walked: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """As ``touched`` with the columns of the edges (edge, source_id, target_id, more) and the names (id, name) of both ends, source and target.

    What is seldom or small is found first and written: edge ids with several pairs of ends, queries of many nodes, the walked nodes. So the
    edges are shuffled only as ways from walked nodes, once by each of their ends.
    """
    missing = F.col("source_id").isNull() | F.col("target_id").isNull()  # such edges go the way of several ends, which holds for any
    per = edges.groupBy("edge").agg(*(f(c).alias(f"_{k}_{c}") for c in ("source_id", "target_id") for k, f in (("low", F.min), ("high", F.max))), F.max(missing).alias("_missing"))
    differ = "_missing OR _low_source_id <> _high_source_id OR _low_target_id <> _high_target_id"
    several = small(per.where(differ).select(F.col("edge").alias("_edge")))
    size = walked.groupBy("query_id").agg(F.count("*").alias("_n"))
    many = small(walked.join(size.where(F.col("_n") > WALKED), "query_id").drop("_n"))
    few = walked.join(small(many.select("query_id").distinct()), "query_id", "left_anti")
    nodes = small(few.select("id").distinct())
    size = nodes.agg(F.sum(F.octet_length(F.col("id").cast("string")))).first()[0] or 0
    nodes = F.broadcast(nodes) if size <= NODE_BYTES else nodes
    plain = edges.join(several, F.col("edge").eqNullSafe(F.col("_edge")), "left_anti")
    at = ways(plain).join(nodes, "id", "left_semi")
    at = at.join(names.select(F.col("id").alias("to"), F.col("name").alias("_to")), "to", "left").join(names.select("id", F.col("name").alias("_at")), "id", "left")
    more = [c for c in edges.columns if c not in ("edge", "source_id", "target_id")]
    ends = {"source_id": ("id", "to"), "source": ("_at", "_to"), "target_id": ("to", "id"), "target": ("_to", "_at")}
    once = from_first_end(few, at).select("query_id", "edge", "hop", *(F.when(F.col("side") == 1, F.col(x)).otherwise(F.col(y)).alias(c) for c, (x, y) in ends.items()), *more)
    rest = stored(least_hops(few, many, edges, several), "least-hops")
    named = with_names(edges.join(small(rest.select("edge").distinct()), "edge", "left_semi"), names)
    return once.unionByName(rest.join(named, "edge").select(*once.columns))


def with_names(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with the names (id, name) of both ends, source and target; null for an end without one."""
    source, target = (names.select(F.col("id").alias(f"{c}_id"), F.col("name").alias(c)) for c in ("source", "target"))
    return edges.join(source, "source_id", "left").join(target, "target_id", "left")


def with_details(nodes: DataFrame, found: DataFrame, entities: DataFrame, edges: DataFrame, hops: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of ``k_hop`` with their entity's columns, and its edges with their own columns and the names of both ends.

    Nodes and ends without an entity keep nulls. With ``hops``, the number that all of ``edges`` was walked for, names are joined to the edges at
    the walked nodes and these to the nodes; without, details are joined to ``found``, the edges touched.
    """
    names = entities.select("id", "name")
    named = edges.withColumnRenamed("id", "edge")
    full = touched_named(nodes.where(F.col("hop") < hops), named, names) if hops else with_names(found.join(named, "edge"), names)
    return nodes.join(entities, "id", "left"), full


def community_summaries(nodes: DataFrame, communities: DataFrame, k: int = 5) -> DataFrame:
    """query_id, id, level, summary, rank of enabled communities that share an entity, highest level first.

    A query's first k are among the first k of one of its entities, so an entity in many communities gives k rows to a query.
    """
    order = [F.col("level").desc(), F.col("id")]
    member = communities.where("enabled").select("id", "level", "summary", F.explode(F.array_distinct("entity_ids")).alias("entity")).distinct()
    hit = nodes.select("query_id", F.col("id").alias("entity")).join(top(member, ["entity"], order, k), "entity").select("query_id", "id", "level", "summary").distinct()
    return top(hit, ["query_id"], order, k, "rank")


def related_passages(nodes: DataFrame, edges: DataFrame, links: DataFrame, k: int = 20, weights: Mapping[str, float] | None = None, scope: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, n_entities, rank of passages linked to visited nodes (links: entity_id, passage_id).

    A node weighs as its heaviest relation (0.5 without one); a passage scores the sum over its distinct nodes,
    and is scored before anything is cut. ``scope`` (passage_id) restricts.
    """
    table = weights or RELATION_WEIGHTS
    w = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("relation_type")), F.lit(OTHER_WEIGHT))
    heavy = edges.select(F.explode(F.array("source_id", "target_id")).alias("id"), w.alias("w")).groupBy("id").agg(F.max("w").alias("w"))
    used = links.select(F.col("entity_id").alias("id"), "passage_id").distinct()
    used = used.join(scope.select("passage_id").distinct(), "passage_id", "left_semi") if scope is not None else used
    scored = nodes.select("query_id", "id").distinct().join(heavy, "id", "left").withColumn("w", F.coalesce("w", F.lit(OTHER_WEIGHT))).join(used, "id")
    total = scored.groupBy("query_id", F.col("passage_id").alias("id")).agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("n_entities"))
    return top(total, ["query_id"], [F.col("score").desc(), F.col("id")], k, "rank")


def graph_search(seeds: DataFrame, edges: DataFrame, links: DataFrame, communities: DataFrame, limit: int = 3, hops: int = 2) -> DataFrame:
    """query_id, kind, id, rank: passages of the visited nodes, then community summaries, ``limit`` in all."""
    nodes, _ = k_hop(seeds, edges, hops)
    p = related_passages(nodes, edges, links, limit).select("query_id", F.lit("passage").alias("kind"), "id", F.col("rank").alias("_r"), F.lit(0).alias("_s"))
    c = community_summaries(nodes, communities, limit).select("query_id", F.lit("community").alias("kind"), "id", F.col("rank").alias("_r"), F.lit(1).alias("_s"))
    return top(p.unionByName(c), ["query_id"], [F.col("_s"), F.col("_r")], limit, "rank").drop("_s", "_r")


#: Ids of a document that a block holds, passages that follow one another for an entity, so that written pairs repeat within a page, and pairs of a batch.
BLOCK, TURN, PAIRS = 4096, 256, 1 << 16


def link_entities(entities: DataFrame, passages: DataFrame) -> DataFrame:
    """entity_id, passage_id of the passages of the entity's document.

    Rows are made distinct before they are joined. A pair can come twice only if both its entity and its passage are listed with
    several documents; only such pairs are made distinct again. A document's entities meet its passages block by block, so a long one is
    spread, and 16,000,000 pairs cost a shuffle two blocks (64 KB).
    """
    e, p = (id_blocks(with_several(df.select("id", "doc_id").where("doc_id IS NOT NULL").distinct(), "id", "doc_id"), name) for df, name in ((entities, "entity_id"), (passages, "passage_id")))
    p = p.withColumnsRenamed({"_several": "_both", "_block": "_other"})
    lanes = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    shape = ", ".join(f"{name} {df.schema['id'].dataType.simpleString()}" for name, df in (("entity_id", entities), ("passage_id", passages)))

    def pairs(met: DataFrame) -> DataFrame:
        # Blocks that meet are few and their pairs many, so the number of tasks is written: by its bytes Spark would take one.
        return met.repartition(lanes, "doc_id", "_block", "_other").select("entity_id", "passage_id").mapInArrow(crossed, shape)

    ship(entities.sparkSession)
    once = pairs(e.join(p, "doc_id").where("NOT (_several AND _both)"))
    return once.unionByName(pairs(e.where("_several").join(p.where("_both"), "doc_id")).distinct())


def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of the ids of two blocks in a row, ``TURN`` passages at a time for each entity."""
    for batch in batches:
        for mine, theirs in zip(*batch.columns, strict=True):
            e, p = mine.values, theirs.values
            for at in range(0, len(p), TURN):
                turn = p.slice(at, TURN)
                each = max(1, PAIRS // len(turn))
                for first in range(0, len(e), each):
                    some = e.slice(first, each)
                    columns = [some.take(pa.array(np.repeat(np.arange(len(some)), len(turn)))), turn.take(pa.array(np.tile(np.arange(len(turn)), len(some))))]
                    yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def id_blocks(rows: DataFrame, name: str) -> DataFrame:
    """doc_id, _several, _block and ``name``, an array of up to ``BLOCK`` ids in order, of rows (id, doc_id, _several); written."""
    at = numbered(rows, ["doc_id", "_several"], ["id"], "_at").withColumn("_block", F.floor(F.col("_at") / BLOCK))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("_at", "id"))), lambda x: x["id"])
    return stored(at.groupBy("doc_id", "_several", "_block").agg(ids.alias(name)), "id-blocks")


def with_several(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``_several``: whether the key has more than one value."""
    many = rows.groupBy(F.col(key).alias("_key")).agg((F.min(value) < F.max(value)).alias("_several")).where("_several")
    return rows.join(many, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, value, F.coalesce("_several", F.lit(False)).alias("_several"))


def resolve_edges(raw: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id, relation_type of edges given by names, each once; the smallest id of a name."""
    ids = entities.groupBy("name").agg(F.min("id").alias("id"))
    out = raw.join(ids.select(F.col("name").alias("source"), F.col("id").alias("source_id")), "source").join(ids.select(F.col("name").alias("target"), F.col("id").alias("target_id")), "target")
    return out.select("source_id", "target_id", "relation_type").distinct()


def rule_entity_map(rule_map: DataFrame, entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """note_qc_code, entity_id pairs that share a document, without the known ones.

    Both sides are made distinct before they meet: a rule that names a document often meets its entities once.
    """
    pairs = rule_map.select("note_qc_code", "doc_id").distinct().join(entities.select(F.col("id").alias("entity_id"), "doc_id").distinct(), "doc_id")
    out = pairs.select("note_qc_code", "entity_id").distinct()
    return out if known is None else out.join(known.select("note_qc_code", "entity_id"), ["note_qc_code", "entity_id"], "left_anti")


def graph_stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Kind (entity, relation), name, n."""
    one = entities.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("entity"))
    two = edges.groupBy(F.col("relation_type").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("relation"))
    return one.unionByName(two).select("kind", "name", "n")


def doc_entities(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (doc, entity) rows the distinct entities per doc, and the entities in several documents with their number."""
    d = pairs.select("doc", "entity").distinct()
    return d.groupBy("doc").agg(F.count("*").alias("entities")), d.groupBy("entity").agg(F.count("*").alias("docs")).where("docs > 1")


def match_doc_paths(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """Key and doc_id (null: unmatched) by the last segment of the paths, any trailing slash off."""
    last = lambda c: F.element_at(F.split(F.regexp_replace(c, "/+$", ""), "/"), -1)
    d = docs.select(last(F.col("path")).alias("_last"), "doc_id").groupBy("_last").agg(F.min("doc_id").alias("doc_id"))
    return keys.withColumn("_last", last(F.col("key"))).join(d, "_last", "left").select("key", "doc_id")


def chunks_by_docs(scope: DataFrame, mapping: DataFrame, chunks: DataFrame, n: int = 200) -> DataFrame:
    """Chunks of the mapped documents in scope, content cut to n characters and "..."."""
    out = scope.join(mapping, "doc_id").join(chunks, "key")
    return out.withColumn("content", F.when(F.length("content") > n, F.concat(F.left("content", F.lit(n)), F.lit("..."))).otherwise(F.col("content")))


def filter_allowed_paths(rows: DataFrame, scope: DataFrame, limit: int) -> DataFrame:
    """Rows (query_id, path, rank) whose path is in scope (query_id, path); all rows of a query that would keep none; ``limit`` each."""
    flagged = rows.join(scope.select("query_id", "path").distinct().withColumn("_in", F.lit(1)), ["query_id", "path"], "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    kept = flagged.withColumn("_any", F.max("_in").over(Window.partitionBy("query_id"))).where("_in = _any")
    return top(kept, ["query_id"], [F.col("rank"), F.col("path")], limit).drop("_in", "_any")


def merged_documents(docs: DataFrame, passages: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """doc_id, path, part_no, text, n of documents with enabled passages, joined by a blank line in id order; path is node_path, file_path or title.

    A text of more than ``budget`` bytes comes in parts (``part_numbers``), each a row of n passages; paths are joined last.
    """
    rows = part_numbers(passages.where("enabled").select("doc_id", "id", "content"), ["doc_id"], ["id"], F.octet_length("content") + 2, budget)
    texts = rows.groupBy("doc_id", "part_no").agg(F.sort_array(F.collect_list(F.struct("_id", "content"))).alias("p"))
    path = F.coalesce(F.nullif(F.col("node_path"), F.lit("")), F.nullif(F.col("file_path"), F.lit("")), F.col("title"))
    return texts.join(docs.select(F.col("id").alias("doc_id"), path.alias("path")), "doc_id").select("doc_id", "path", "part_no", F.array_join(F.col("p.content"), "\n\n").alias("text"), F.size("p").alias("n"))