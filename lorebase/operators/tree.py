"""H: the tree of books, chapters and sections. docs(id, title, domain, level, parent_id, node_path, enabled), passages(id, doc_id, content, enabled)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorebase.operators.common import PART_BYTES, part_numbers, top
from lorebase.workers import stored


def with_book(passages: DataFrame, docs: DataFrame) -> DataFrame:
    """H1: adds doc_title and book_title: the title two levels up, else one level up, else the document's own. Orphans stay."""
    d = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), F.col("parent_id").alias("_up"))
    c = docs.select(F.col("id").alias("_up"), F.col("title").alias("_chapter"), F.col("parent_id").alias("_upup"))
    b = docs.select(F.col("id").alias("_upup"), F.col("title").alias("_book"))
    out = passages.join(d, "doc_id", "left").join(c, "_up", "left").join(b, "_upup", "left")
    return out.withColumn("book_title", F.coalesce("_book", "_chapter", "doc_title")).drop("_up", "_upup", "_chapter", "_book")


def subtree(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """H2: root, id and depth of every node reachable from ``roots`` (column id), itself included.

    A node counts once for a root, at its smallest depth, so cycles end and the walk goes on until no node is new, however
    deep the tree. Each level is a join of the frontier, written to the shared folder.
    """
    children = docs.select(F.col("id").alias("child"), F.col("parent_id").alias("id")).where("id IS NOT NULL")
    seen = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    frontier, depth = seen, 0
    while True:
        depth += 1
        found = frontier.join(children, "id").select("root", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct()
        frontier = stored(found.join(seen.select("root", "id"), ["root", "id"], "left_anti"), "subtree")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def resolve_scope(docs: DataFrame, books: DataFrame) -> DataFrame:
    """H3: book_id, doc_id of enabled books (column id of ``books``), their enabled children and grandchildren."""
    on = docs.where("enabled").select("id", "parent_id")
    book = on.join(books.select("id"), "id", "left_semi").select(F.col("id").alias("book_id"), F.col("id").alias("doc_id"))
    child = book.join(on, F.col("parent_id") == F.col("doc_id")).select("book_id", F.col("id").alias("doc_id"))
    grand = child.join(on, F.col("parent_id") == F.col("doc_id")).select("book_id", F.col("id").alias("doc_id"))
    return book.unionByName(child).unionByName(grand).distinct()


def book_stats(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """H4: book_id, title, descendants and enabled passages of the subtree of every level-0 book."""
    tree = subtree(docs, docs.where("level = 0")).select(F.col("root").alias("book_id"), "id")
    per_doc = passages.where("enabled").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    counts = tree.join(per_doc, "id", "left").groupBy("book_id").agg((F.count("*") - 1).alias("descendants"), F.coalesce(F.sum("n"), F.lit(0)).alias("passages"))
    return docs.where("level = 0").select(F.col("id").alias("book_id"), "title").join(counts, "book_id")


def kb_structure(docs: DataFrame, passages: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """H5: every node with its passages as an array ordered by id; more than ``budget`` bytes of them come in parts (part_no), a row each."""
    rows = part_numbers(passages.select("doc_id", "id", "content"), ["doc_id"], ["id"], F.octet_length("content"), budget)
    held = rows.groupBy("doc_id", "part_no").agg(F.sort_array(F.collect_list(F.struct("_id", "id", "content"))).alias("p"))
    held = held.select(F.col("doc_id").alias("id"), "part_no", F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["content"].alias("content"))).alias("passages"))
    return docs.join(held, "id", "left").withColumn("part_no", F.coalesce("part_no", F.lit(0)))


def level_counts(docs: DataFrame) -> DataFrame:
    """H5: nodes per level."""
    return docs.groupBy("level").agg(F.count("*").alias("nodes"))


def structure_totals(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """H5: kind and n: the nodes of each level, and all passages."""
    levels = level_counts(docs).select(F.concat(F.lit("level "), F.col("level").cast("string")).alias("kind"), F.col("nodes").alias("n"))
    return levels.unionByName(passages.agg(F.count("*").alias("n")).select(F.lit("passages").alias("kind"), "n"))


def set_enabled(docs: DataFrame, passages: DataFrame, roots: DataFrame, flag: bool) -> tuple[DataFrame, DataFrame]:
    """H6: ``docs`` and ``passages`` with ``enabled`` set on the subtrees of ``roots``."""
    hit = subtree(docs, roots).select("id").distinct().withColumn("_hit", F.lit(True))
    put = F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("enabled"))
    return docs.join(hit, "id", "left").withColumn("enabled", put).drop("_hit"), passages.join(hit.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("enabled", put).drop("_hit")


def doc_tree(docs: DataFrame, passages: DataFrame, books: Sequence[int] | None = None) -> DataFrame:
    """H7: chapters (level 1) with sections as an array of (node_path, id, title, n), n passages each, 0 if none."""
    n = passages.where("enabled").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    counted = docs.where("enabled").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    chapters = counted.where("level = 1")
    chapters = chapters.where(F.col("parent_id").isin(*books)) if books else chapters
    sections = counted.where("level = 2").groupBy("parent_id").agg(F.sort_array(F.collect_list(F.struct("node_path", "id", "title", "n"))).alias("sections"))
    return chapters.join(sections.withColumnRenamed("parent_id", "id"), "id", "left").select("id", "title", "node_path", "n", "sections")


def leaf_chapters(docs: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """H8: id, title, level, book_id, book_title of level 2 in books that have it and of level 1 in others; the book must be enabled."""
    on = docs.where("enabled")
    books = on.where("level = 0").select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    books = books.where(~F.col("book_title").isin(*skip)) if skip else books
    first = on.where("level = 1").join(books, F.col("parent_id") == F.col("book_id")).select("id", "title", "level", "book_id", "book_title")
    above = first.select(F.col("id").alias("chapter_id"), "book_id", "book_title")
    second = on.where("level = 2").join(above, F.col("parent_id") == F.col("chapter_id")).select("id", "title", "level", "book_id", "book_title")
    return second.unionByName(first.join(second.select("book_id").distinct(), "book_id", "left_anti").select(*second.columns))


def topic_books(passages: DataFrame, docs: DataFrame, terms: Sequence[str], k: int = 5, only_enabled: bool = False) -> DataFrame:
    """H9: the k books with most passages that share a term (array content_terms), hits by either path summed per title."""
    hit = passages.where(F.arrays_overlap("content_terms", F.array(*map(F.lit, terms))))
    hit = (hit.where("enabled") if only_enabled else hit).select("doc_id")
    d, up, book = docs.alias("d"), docs.alias("u"), docs.where("level = 0").alias("b")
    one = hit.join(d, F.col("doc_id") == F.col("d.id")).join(book, F.col("d.parent_id") == F.col("b.id")).select(F.col("b.title").alias("title"))
    two = hit.join(d, F.col("doc_id") == F.col("d.id")).join(up, F.col("d.parent_id") == F.col("u.id")).join(book, F.col("u.parent_id") == F.col("b.id")).select(F.col("b.title").alias("title"))
    return one.unionByName(two).groupBy("title").agg(F.count("*").alias("hits")).orderBy(F.col("hits").desc(), "title").limit(k)


def whitelist_books(listed: DataFrame, domain: str | None = None, k: int = 8) -> DataFrame:
    """Of every domain (or one) the k newest enabled listed books, ties by title."""
    on = listed.where("enabled")
    return top(on.where(F.col("domain") == domain) if domain else on, ["domain"], [F.col("year").desc(), F.col("title")], k, "rank")


