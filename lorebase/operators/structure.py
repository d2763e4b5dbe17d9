"""T: books as line tables (doc_id, line_no, page_no, text, size_min, size_max) cut into chapters and passages."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lorebase.operators.common import PART_BYTES, before, numbered, part_numbers, ranged, top
from lorebase.operators.tree import subtree
from lorebase.workers import ship

# Forms of headings and table-of-contents lines.
_NUM, _CJK_NUM = "[0-9０-９]{1,3}[.．、]", "[一二三四五六七八九十]+、"
_ANY = "[一二三四五六七八九十百千万0-9０-９]+"
CHAPTER, SECTION, APPENDIX = f"^第{_ANY}章", f"^第{_ANY}[节篇部分]", "^附[录篇]"
PAREN = "^（[一二三四五六七八九十]+）"
TOC_TITLE, DOT_PAGE, DOT_ONLY = r"^(.{2,40}?)(?:\s*[.．·]+\s*(\d{1,3})|(\d{1,3}))\s*$", r"^[.．·\s]{5,}(\d{1,3})\s*$", r"^[.．·\s]{5,}$"
HEADING_LIKE = f"^(第{_ANY}[章节篇部分]|附[录篇]|（[一二三四五六七八九十]+）|{_CJK_NUM}|{_NUM})"


def _by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def lines_from_items(items: DataFrame) -> DataFrame:
    """Page glyphs (doc_id, page_no, ord, str, y, size) to lines: a new one where y moves by more than 3; a space joins two items unless CJK meets at the seam."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("ord")
    i = items.where(F.length(F.trim("str")) > 0).withColumn("_new", F.coalesce((F.abs(F.col("y") - F.lag("y").over(w)) > 3).cast("int"), F.lit(1)))
    i = i.withColumn("line", F.sum("_new").over(w))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "str"))), lambda x: x["str"])
    cjk = "[一-龥]"
    text = F.aggregate(parts, F.lit(""), lambda a, s: F.when(a == "", s).when(a.rlike(cjk + "$") | s.rlike("^" + cjk), F.concat(a, s)).otherwise(F.concat(a, F.lit(" "), s)))
    return i.groupBy("doc_id", "page_no", "line").agg(text.alias("text"), F.min("size").alias("size_min"), F.max("size").alias("size_max"))


def line_page_map(pages: DataFrame) -> DataFrame:
    """Lines of the pages (doc_id, page_no, text) that are not empty, numbered through the document, a blank line between pages with the page before it."""
    full = pages.where(F.length(F.trim("text")) > 0).withColumn("_last", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("page_no").desc())) == 1)
    rows = full.select("doc_id", "page_no", F.posexplode(F.concat(F.split("text", "\r?\n"), F.when(F.col("_last"), F.array().cast("array<string>")).otherwise(F.array(F.lit(""))))).alias("pos", "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "pos")) - 1
    return rows.select("doc_id", place.alias("line_no"), "page_no", "text")


def toc_entries(lines: DataFrame) -> DataFrame:
    """doc_id, page_no, line_no, title, target: entries "title dots page", "title page", or a title with dots and page on a following line."""
    t = F.trim("text")
    titled, dotted = t.rlike(TOC_TITLE), t.rlike(DOT_PAGE)
    plain = F.length(t).between(2, 40) & ~t.rlike(r"^\d{1,3}$") & ~t.rlike("[。；]")
    kind = F.when(dotted, "page").when(t.rlike(DOT_ONLY), "dots").when(titled, "entry").when(plain, "title").otherwise("other")
    rows = lines.where(F.length(t) > 0).withColumn("_t", t).withColumn("_kind", kind)
    w = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last(F.when(F.col("_kind") != "dots", F.struct("_kind", "_t")), ignorenulls=True).over(w)
    rows = rows.withColumn("_before", held)
    title = F.when(F.col("_kind") == "entry", F.trim(F.regexp_replace(F.regexp_extract("_t", TOC_TITLE, 1), r"[.．·\s]+$", ""))).when((F.col("_kind") == "page") & (F.col("_before._kind") == "title"), F.col("_before._t"))
    page = F.when(F.col("_kind") == "entry", F.coalesce(F.nullif(F.regexp_extract("_t", TOC_TITLE, 2), F.lit("")), F.regexp_extract("_t", TOC_TITLE, 3))).otherwise(F.regexp_extract("_t", DOT_PAGE, 1))
    out = rows.select("doc_id", "page_no", "line_no", title.alias("title"), page.try_cast("int").alias("target"))
    return out.where((F.length("title") >= 2) & (F.col("target") > 0) & ~F.col("title").rlike("[a-zA-Z]{2,}") & ~F.col("title").rlike(r"^\d{1,3}$"))


def toc_pages(lines: DataFrame) -> DataFrame:
    """T4: doc_id, page_no, is_toc; where all pages of a document would be, none is."""
    t = F.trim("text")
    like = t.rlike(TOC_TITLE) | t.rlike(DOT_PAGE) | t.rlike(DOT_ONLY) | (F.length(t).between(2, 40) & ~t.rlike(r"^\d{1,3}$") & ~t.rlike("[。；]"))
    share = lines.where(F.length(t) > 0).groupBy("doc_id", "page_no").agg(F.count("*").alias("n"), F.avg(like.cast("int")).alias("share"))
    numbered = F.col("title").rlike(f"^(第{_ANY}[章节篇]|附[录篇]|{_CJK_NUM}|{_NUM})")
    e = toc_entries(lines).groupBy("doc_id", "page_no").agg(F.count("*").alias("e"), F.avg(numbered.cast("int")).alias("numbered"))
    out = share.join(e, ["doc_id", "page_no"], "left").withColumn("is_toc", F.coalesce((F.col("n") >= 5) & (F.col("share") > 0.35) & (F.col("e") >= 3) & (F.col("numbered") >= 0.5), F.lit(False)))
    every = F.min(F.col("is_toc").cast("int")).over(Window.partitionBy("doc_id")) == 1
    return out.select("doc_id", "page_no", (F.col("is_toc") & ~every).alias("is_toc"))


def infer_toc_levels(entries: DataFrame) -> DataFrame:
    """T5: adds level to entries (doc_id, ord, title)."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    t = F.trim("title")
    signal = F.max((t.rlike(CHAPTER) | t.rlike(APPENDIX) | t.rlike("^" + _CJK_NUM)).cast("int")).over(Window.partitionBy("doc_id")) == 1
    item = t.rlike("^" + _CJK_NUM) & ~t.rlike(CHAPTER) & ~t.rlike(SECTION)
    rows = entries.withColumn("_item", item).withColumn("_signal", signal).withColumn("_before", F.lag(t).over(w))
    starts = F.col("_item") & ~F.coalesce(F.lag("_item").over(w), F.lit(False))
    rows = rows.withColumn("_start", starts)
    # A run of items takes the level of its first one, which follows from the entry before the run.
    b = F.col("_before")
    first = F.when(F.col("_start"), F.when(b.rlike(SECTION) | b.rlike(APPENDIX) | b.rlike("^" + _NUM), 2).otherwise(1))
    run = F.last(first, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    level = F.when(t.rlike(CHAPTER), 1).when(t.rlike(SECTION), 2).when(t.rlike(APPENDIX), 1).when(t.rlike("^" + _NUM), 2).when(t.rlike(PAREN), F.when(F.col("_signal"), 2).otherwise(1)).when(F.col("_item"), run).otherwise(1)
    return rows.withColumn("level", level).drop("_item", "_signal", "_before", "_start")


# What is left out before a title is compared with a line, and what numbers a title.
TOC_LEFT_OUT = r"[\s.．·…|｜\-—（）()]"
TOC_NUMBER = f"^(第{_ANY}[章节篇部分]|附录?[0-9一二三四五六七八九十]*|（[一二三四五六七八九十]+）|{_CJK_NUM}|{_NUM})"


def split_by_toc(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, ord, title, level, parent_ord, start_line, page_no, content: entries matched to lines in order from the last match on.

    Titles and lines are compared without white space, dots, bars, dashes and brackets; titles and lines under three
    characters then, and lines under 2 or over 60, are passed over. Equal 100, and the search ends; a common start of 4 and 60 % of the
    shorter 60 + min(start, 30); a line that contains the title without its number, four characters at least, 55; 15 more within
    two pages. Under three matches give no rows; level-2 contents under 20 characters are dropped. start_line and
    page_no are those of the heading's line. One document is one group: the cursor needs its lines in order.
    """
    left_out, number = re.compile(TOC_LEFT_OUT), re.compile(TOC_NUMBER)

    def score(title: str, body: str, line: str) -> int:
        if line == title:
            return 100
        same = next((i for i, (x, y) in enumerate(zip(title, line, strict=False)) if x != y), min(len(title), len(line)))
        if same >= 4 and same >= 0.6 * min(len(title), len(line)):
            return 60 + min(same, 30)
        return 55 if len(body) >= 4 and body in line else 0

    def since(places: list[int], at: int) -> Iterator[int]:
        return (places[j] for j in range(bisect_left(places, at), len(places)))

    def run(key: tuple, e: pa.Table, x: pa.Table) -> pa.Table:
        e, x = e.sort_by("ord").to_pylist(), x.sort_by("line_no").to_pydict()
        texts, pages = x["text"], x["page_no"]
        plain = [left_out.sub("", t) if 2 <= len(t) <= 60 else "" for t in ((t or "").strip() for t in texts)]
        plain = [p if len(p) >= 3 else "" for p in plain]
        # A line can score only if it equals the title, starts with its first four characters, or holds its body with the body's first four.
        equal, start, holds = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, p in enumerate(plain):
            if p:
                equal[p].append(i)
                start[p[:4]].append(i)
                for gram in {p[j : j + 4] for j in range(len(p) - 3)}:
                    holds[gram].append(i)
        found, at = [], 0
        for row in e:
            title = left_out.sub("", row["title"] or "")
            body, best, where = number.sub("", title), 0, -1
            lists = [equal.get(title, ()), start.get(title[:4], ()) if len(title) >= 4 else (), holds.get(body[:4], ()) if len(body) >= 4 else ()] if len(title) >= 3 else []
            for i in merge(*(since(c, at) for c in lists)):
                s = score(title, body, plain[i])
                if s and row["target"] is not None and pages[i] is not None and abs(int(pages[i]) - int(row["target"])) <= 2:
                    s += 15
                if s > best:
                    best, where = s, i
                if s >= 100:
                    break
            if where >= 0:
                found.append((row["ord"], row["title"], int(row["level"]), where))
                at = where + 1
        rows, parent = [], None
        doc = key[0].as_py() if isinstance(key[0], pa.Scalar) else key[0]
        for n, (ord_, title, level, where) in enumerate(found if len(found) >= 3 else []):
            end = found[n + 1][3] if n + 1 < len(found) else len(texts)
            text = "\n".join(t or "" for t in texts[where + 1 : end]).strip()
            if level == 1:
                parent = ord_
            if level == 1 or len(text) >= 20:
                rows.append((doc, ord_, title, level, parent if level != 1 else None, x["line_no"][where], pages[where], text))
        columns = list(zip(*rows, strict=True)) or [()] * len(types)
        return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

    ship(lines.sparkSession)
    doc_type = lines.schema["doc_id"].dataType
    schema = f"doc_id {doc_type.simpleString()}, ord int, title string, level int, parent_ord int, start_line int, page_no int, content string"
    kinds = {"title": pa.string(), "content": pa.string(), "doc_id": to_arrow_type(doc_type)}
    types = pa.schema([(c, kinds.get(c, pa.int32())) for c in ("doc_id", "ord", "title", "level", "parent_ord", "start_line", "page_no", "content")])
    return entries.groupBy("doc_id").cogroup(lines.select("doc_id", "line_no", "page_no", "text").groupBy("doc_id")).applyInArrow(run, schema)


def split_by_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, ord, title, level, page_idx, parent_ord, content of an outline (doc_id, ord, title, page_idx, items array of (title, page_idx)) over pages (doc_id, page_idx, text)."""
    tops = outline.select("doc_id", "ord", F.lit(-1).alias("pos"), "title", "page_idx", F.lit(1).alias("level"))
    subs = outline.select("doc_id", "ord", F.posexplode("items").alias("pos", "i"), F.col("page_idx").alias("_up")).select("doc_id", "ord", "pos", F.col("i.title").alias("title"), F.col("i.page_idx").alias("page_idx"), F.lit(2).alias("level"), "_up").where("page_idx > _up").drop("_up")
    rows = tops.unionByName(subs)
    w = Window.partitionBy("doc_id").orderBy("page_idx", "ord", "pos")
    appendix = F.last(F.when((F.col("pos") == -1) & ~F.col("title").rlike("^" + _CJK_NUM), F.col("title").rlike(APPENDIX)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    low = (F.col("pos") == -1) & (F.col("title").rlike("^" + _NUM) | (F.col("title").rlike("^" + _CJK_NUM) & F.coalesce(appendix, F.lit(False))))
    rows = rows.withColumn("level", F.when(low, 2).otherwise(F.col("level"))).withColumn("n", F.row_number().over(w)).withColumn("end", F.coalesce(F.lead("page_idx").over(w), F.lit(1 << 30)))
    inside = rows.join(pages.select("doc_id", F.col("page_idx").alias("p"), "text"), "doc_id").where("p >= page_idx AND p < end")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "text"))), lambda x: x["text"]), "\n")
    out = inside.groupBy("doc_id", "n", "title", "level", "page_idx").agg(text.alias("content")).where(F.length("content") >= 50)
    parent = F.last(F.when(F.col("level") == 1, F.col("n")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("parent_ord", F.when(F.col("level") == 2, parent)).withColumnRenamed("n", "ord")


def heading_level(text: Column) -> Column:
    """1 or 2 for a heading of 60 characters at most, else null."""
    t = F.trim(text)
    short = F.length(t) <= 30
    sub = t.rlike("^[0-9０-９]{1,3}[.．、][0-9０-９]{1,3}")
    level = F.when(t.rlike(r"^#\s+\S"), 1).when(t.rlike(r"^#{2,3}\s+\S"), 2).when(t.rlike(CHAPTER), 1).when(t.rlike(SECTION), 2).when(t.rlike(APPENDIX) & short, 1).when(t.rlike("^" + _CJK_NUM + r"\S") & short, 1).when(t.rlike("^" + _NUM + r"\s*\S") & short, F.when(sub, 2).otherwise(1))
    return F.when(F.length(t).between(1, 60), level)


def base_font_size(lines: DataFrame) -> DataFrame:
    """doc_id, base: most frequent size above 0, to 0.1; of equal counts the one seen first."""
    s = lines.where(F.col("size_max") > 0).groupBy("doc_id", F.round("size_max", 1).alias("base")).agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    return top(s, ["doc_id"], [F.col("n").desc(), F.col("first")], 1).select("doc_id", "base")


def drop_running_headers(lines: DataFrame) -> DataFrame:
    """Adds level: null for body lines, headings seen three times that are not large, and small ones; large sizes set 1 or 2; numbered ones of body size are 2."""
    t = F.trim("text")
    rows = lines.join(base_font_size(lines), "doc_id", "left").withColumn("_h", heading_level(F.col("text")))
    seen = F.count(F.when(F.col("_h").isNotNull(), 1)).over(Window.partitionBy("doc_id", t))
    ratio = F.when((F.col("size_max") > 0) & (F.col("base") > 0), F.col("size_max") / F.col("base"))
    large = F.coalesce(ratio >= 1.45, F.lit(False))
    level = F.when((seen >= 3) & ~large, None).when(ratio < 0.85, None).when(large, 1).when(ratio >= 1.18, 2).when(ratio.isNotNull() & (t.rlike("^" + _CJK_NUM) | t.rlike("^" + _NUM)), 2).otherwise(F.col("_h"))
    return rows.withColumn("level", F.when(F.col("_h").isNotNull(), level)).drop("_h", "base")


def split_chapters(lines: DataFrame) -> DataFrame:
    """doc_id, ord, title, level, parent_ord, start_line, page_no, content.

    A heading starts a node and later lines are its content; numbered items after any heading, and 一、 items
    after an appendix, are level 2; nodes under 20 characters, and table notes, go into the node before;
    without a heading the document is one node 正文.
    """
    w = _by_line()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = lines if "level" in lines.columns else drop_running_headers(lines)
    t = F.trim(F.regexp_replace("text", r"^#{1,3}\s+", ""))
    # A numbered item can open a chapter only before the first heading; only what is no item can be the latest chapter then.
    item, yi = t.rlike("^" + _NUM), t.rlike("^" + _CJK_NUM)
    own = F.when((F.col("level") == 1) & ~item, F.struct(F.col("line_no"), t.rlike(APPENDIX).alias("appendix"), yi.alias("yi")))
    rows = rows.withColumn("_t", t).withColumn("_top", F.last(F.when(~yi, own), ignorenulls=True).over(before)).withColumn("_any", F.max(F.when(F.col("level").isNotNull(), 1)).over(before))
    lower = (F.col("level") == 1) & ((item & F.col("_any").isNotNull()) | (yi & F.coalesce(F.col("_top.appendix"), F.lit(False))))
    rows = rows.withColumn("level", F.when(lower, 2).otherwise(F.col("level")))
    rows = rows.withColumn("node", F.sum(F.col("level").isNotNull().cast("int")).over(upto))
    headed = F.max("node").over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("_headed", headed).where((F.col("node") > 0) | (F.col("_headed") == 0))
    body = F.sort_array(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "text"))))
    head = F.min(F.when(F.col("level").isNotNull(), F.struct("line_no", "_t", "level", "page_no")))
    nodes = rows.groupBy("doc_id", "node").agg(head.alias("h"), F.trim(F.array_join(F.transform(body, lambda x: x["text"]), "\n")).alias("content"), F.min("line_no").alias("start_line"), F.min("page_no").alias("page_no"))
    nodes = nodes.select("doc_id", "node", F.coalesce("h._t", F.lit("正文")).alias("title"), F.coalesce("h.level", F.lit(1)).alias("level"), "start_line", "page_no", "content")
    n = Window.partitionBy("doc_id").orderBy("node")
    fake = (F.length("content") < 20) | F.col("title").rlike(r"^[0-9０-９]{1,3}\s*[.．、]\s*\*") | F.col("title").contains("为食谱中用到的食药物质")
    kept = F.when((F.row_number().over(n) == 1) | ~fake, 1).otherwise(0)
    nodes = nodes.withColumn("_kept", kept).withColumn("ord", F.sum("_kept").over(n.rowsBetween(Window.unboundedPreceding, 0)))
    piece = F.when(F.col("_kept") == 1, F.col("content")).otherwise(F.concat_ws("\n", "title", F.nullif(F.col("content"), F.lit(""))))
    joined = F.array_join(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("node", piece.alias("p")))), lambda x: x["p"]), lambda x: x != ""), "\n")
    out = nodes.groupBy("doc_id", "ord").agg(F.min_by("title", "node").alias("title"), F.min_by("level", "node").alias("level"), F.min("start_line").alias("start_line"), F.min_by("page_no", "node").alias("page_no"), joined.alias("content"))
    parent = F.last(F.when(F.col("level") == 1, F.col("ord")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("parent_ord", F.when(F.col("level") == 2, parent))


def doc_shape(lines: DataFrame, structured: DataFrame | None = None) -> DataFrame:
    """doc_id, shape: book or nonbook by the number and share of lines that look like headings; book where ``structured`` (doc_id, entries) has three."""
    t = F.trim("text")
    s = lines.where(F.length(t) >= 2).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(t.rlike(HEADING_LIKE)).alias("h"))
    s = s.join(structured, "doc_id", "left") if structured is not None else s.withColumn("entries", F.lit(0))
    non = (F.col("n") >= 30) & ((F.col("h") >= 60) | ((F.col("h") >= 30) & (F.col("h") / F.col("n") >= 0.12)))
    return s.select("doc_id", F.when(F.coalesce("entries", F.lit(0)) >= 3, "book").when(non, "nonbook").otherwise("book").alias("shape"))


def title_from_text(text: Column) -> Column:
    """The first of the first 12 lines of 5,000 characters that can be a title, else null."""
    lines = F.slice(F.filter(F.transform(F.split(F.left(text, F.lit(5000)), "\n+"), lambda x: F.trim(x)), lambda x: x != ""), 1, 12)
    bad = r"^[\d\s.\-—|]+$|^[一二三四五六七八九十]+、|" + SECTION + "|" + CHAPTER + "|^" + _NUM + r"|^[（(][一二三四五六七八九十0-9]+[）)]|(?i)^(人民卫生出版社|卫生部|国家卫生健康|www\.|http|\d{4}年|ISBN)"
    return F.get(F.filter(lines, lambda x: F.length(x).between(2, 60) & ~x.rlike(bad)), F.lit(0))


def book_title(given: Column, path: Column, text: Column) -> Column:
    """The given title, else the file's stem, else (digits, too short or an id) the text's title, else 未命名书籍."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    fit = F.when((F.length(stem) >= 2) & ~stem.rlike(r"^\d+$") & ~stem.rlike("^[A-Za-z0-9]{12,}$"), stem)
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), fit, title_from_text(text), F.lit("未命名书籍"))


def build_chapters(by_toc: DataFrame, by_outline: DataFrame, by_headings: DataFrame, shapes: DataFrame, whole: DataFrame) -> DataFrame:
    """Of every document the nodes (doc_id, ord, title, level, content) by its table of contents, else outline, else headings; a nonbook without the first two is one node of ``whole`` (doc_id, content)."""
    cols = ["doc_id", "ord", "title", "level", "content"]
    first = by_toc.select(*cols)
    second = by_outline.select(*cols).join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    done = first.select("doc_id").unionByName(second.select("doc_id")).distinct()
    non = shapes.where("shape = 'nonbook'").join(done, "doc_id", "left_anti").select("doc_id")
    one = whole.join(non, "doc_id", "left_semi").select("doc_id", F.lit(1).alias("ord"), F.lit("正文").alias("title"), F.lit(1).alias("level"), "content")
    rest = by_headings.select(*cols).join(done.unionByName(non).distinct(), "doc_id", "left_anti")
    return first.unionByName(second).unionByName(one).unionByName(rest)


def split_passages(df: DataFrame, text: str = "content", ends: str = "。；;！？!?", least: int = 20, most: int = 800, pack: int = 500, floor: int = 50) -> DataFrame:
    """Passages of column ``text`` as (chunk_index, passage): blocks between blank lines, lines joined by a space.

    Blocks under ``least`` characters are dropped, up to ``most`` kept; longer ones are split after sentence
    ends and packed: a buffer of ``floor`` or more is given out where the next part would pass ``pack``.
    """
    blocks = F.transform(F.split(F.col(text), r"\r?\n[ \t]*(?:\r?\n[ \t]*)+"), lambda b: F.trim(F.regexp_replace(b, r"\s*\r?\n\s*", " ")))
    blocks = F.filter(blocks, lambda b: F.length(b) >= least)
    none = F.array().cast("array<string>")

    def step(a: Column, part: Column) -> Column:
        over = (F.length(a["buffer"]) + F.length(part) > pack) & (F.length(a["buffer"]) >= floor)
        return F.struct(F.when(over, part).otherwise(F.concat(a["buffer"], part)).alias("buffer"), F.when(over, F.concat(a["out"], F.array(F.trim(a["buffer"])))).otherwise(a["out"]).alias("out"))

    def cut(b: Column) -> Column:
        parts = F.split(b, rf"(?<=[{ends}])\s*")
        packed = F.aggregate(parts, F.struct(F.lit("").alias("buffer"), none.alias("out")), step)
        return F.when(F.length(F.trim(packed["buffer"])) >= least, F.concat(packed["out"], F.array(F.trim(packed["buffer"])))).otherwise(packed["out"])

    pieces = F.flatten(F.transform(blocks, lambda b: F.when(F.length(b) <= most, F.array(b)).otherwise(cut(b))))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(pieces).alias("chunk_index", "passage"))


#: Ends of sentences in ``passages_of_lines``.
ENDS = "。；;！？!?"


class _Block:
    """A run of lines as it comes in: whole while short, else packed by sentences; no more than a buffer and an open sentence is held."""

    def __init__(self, ends: str, least: int, most: int, pack: int, floor: int) -> None:
        self.sentence = re.compile(rf"(?<=[{re.escape(ends)}])\s*", re.ASCII)
        self.least, self.most, self.pack, self.floor = least, most, pack, floor
        self.start(None, None)

    def start(self, key: tuple | None, page: int | None) -> None:
        self.key, self.page, self.open, self.buffer, self.long, self.pieces = key, page, "", "", False, 0

    def add(self, line: str) -> Iterator[tuple]:
        self.open += line if not self.open else f" {line}"
        if self.long or len(self.open) > self.most:
            self.long = True
            *parts, self.open = self.sentence.split(self.open)
            for p in parts:
                yield from self._put(p)

    def _put(self, part: str) -> Iterator[tuple]:
        if len(self.buffer) + len(part) > self.pack and len(self.buffer) >= self.floor:
            yield self._row(self.buffer)
            self.buffer = part
        else:
            self.buffer += part

    def _row(self, text: str) -> tuple:
        self.pieces += 1
        return (*self.key, self.pieces, self.page, text.strip(" "))

    def end(self) -> Iterator[tuple]:
        if self.long:
            yield from self._put(self.open)
            self.open = self.buffer
        if self.key is not None and len(self.open.strip(" ")) >= self.least:
            yield self._row(self.open)


def passages_of_lines(lines: DataFrame, ends: str = ENDS, least: int = 20, most: int = 800, pack: int = 500, floor: int = 50) -> DataFrame:
    """doc_id, chunk_index (from 0), page_no (of the block's first line), passage of lines(doc_id, line_no, page_no, text).

    A block is a run of lines that are not blank, joined by blanks without their own white space at the ends. Blocks under ``least``
    characters are dropped, up to ``most`` kept; longer ones are split after sentence ends and packed: a buffer of
    ``floor`` or more is given out where the next part would pass ``pack``, a last one if it has ``least``.
    A line's block is the last blank line before it, carried over ranges of lines, so a document of any length is spread; lines
    without doc_id or number are left out, null texts are blank.
    """
    ship(lines.sparkSession)
    bare = lines.where("doc_id IS NOT NULL AND line_no IS NOT NULL").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("page_no").cast("int").alias("page_no"), F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "").alias("text"))
    dealt = ranged(bare, ["doc_id"], ["line_no"])
    blank = F.when(F.col("text") == "", F.col("line_no"))
    own = F.max(blank).over(Window.partitionBy("_part", "doc_id").orderBy("line_no"))
    found = dealt.withColumn("_own", own).join(before(dealt, ["doc_id"], blank, F.max), ["doc_id", "_part"])
    blocks = found.where("text <> ''").select("doc_id", F.coalesce("_own", "_before", F.lit(-(1 << 62))).alias("block"), "line_no", "page_no", "text")
    kind = to_arrow_type(lines.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(ends, least, most, pack, floor)

        def rows(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "block", "piece", "page_no", "passage"])

        for batch in batches:
            out: list[tuple] = []
            doc, at, _, page, text = (c.to_pylist() for c in batch.columns)
            for i, line in enumerate(text):
                if (doc[i], at[i]) != block.key:
                    out += block.end()
                    block.start((doc[i], at[i]), page[i])
                out += block.add(line)
            yield rows(out)
        yield rows(list(block.end()))

    dealt = blocks.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "line_no")
    cut = dealt.mapInArrow(run, f"doc_id {lines.schema['doc_id'].dataType.simpleString()}, block long, piece int, page_no int, passage string")
    return numbered(cut, ["doc_id"], ["block", "piece"], "chunk_index").select("doc_id", "chunk_index", "page_no", "passage")


def chunk_sliding(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50, paragraph: str = "\n{2,}") -> DataFrame:
    """chunk_index, chunk: paragraphs over 20 characters, long ones as windows of ``size`` stepping ``size - overlap``."""
    paras = F.filter(F.transform(F.split(F.col(text), paragraph), lambda x: F.trim(x)), lambda p: F.length(p) > 20)
    windows = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size - overlap)), lambda i: F.trim(F.substring(p, i, F.lit(size)))))))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(windows).alias("chunk_index", "chunk"))


def passage_rows(passages: DataFrame, terms: Column | None = None) -> DataFrame:
    """doc_id, section_path, page_no, content, content_terms, content_hash, chunk_index, enabled of (doc_id, title, page_no, chunk_index, passage)."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index")) - 1
    return passages.select("doc_id", F.col("title").alias("section_path"), "page_no", F.col("passage").alias("content"), (terms if terms is not None else F.array().cast("array<string>")).alias("content_terms"), F.md5("passage").alias("content_hash"), place.alias("chunk_index"), F.lit(True).alias("enabled"))


def dedup_content(df: DataFrame, text: str = "content", id_col: str = "id") -> DataFrame:
    """The row of the smallest id for every content; shuffled by its 128-bit hash."""
    first = df.groupBy(F.md5(F.col(text)).alias("content_hash")).agg(F.min(id_col).alias(id_col))
    return df.join(first, id_col, "left_semi")


def replace_same_title(old: DataFrame, passages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old documents with new ones added, books of a new book's title off with their subtree, and the passages likewise."""
    roots = old.where("enabled AND level = 0").join(new.where("level = 0").select("title"), "title", "left_semi")
    off = subtree(old, roots).select("id").distinct().withColumn("_off", F.lit(True))
    put = F.when(F.col("_off"), F.lit(False)).otherwise(F.col("enabled"))
    docs = old.join(off, "id", "left").withColumn("enabled", put).drop("_off")
    return docs.unionByName(new, allowMissingColumns=True), passages.join(off.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("enabled", put).drop("_off")


def rules_to_markdown(rules: DataFrame, budget: int = PART_BYTES) -> DataFrame:
    """Cls, part_no, n, text: a heading with the class and its number n of rules, a section for every rule with the fields it has (rules: cls, code, name, fields map).

    A class of more than ``budget`` bytes comes in parts, the first with the heading. Null classes are left out.
    """
    fields = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda k, v: F.length(v) > 0))), lambda e: F.concat(F.lit("- "), e["key"], F.lit("："), e["value"])), "\n")
    one = F.concat_ws("\n", F.concat(F.lit("## "), "code", F.lit(" "), "name"), fields)
    sections = part_numbers(rules.select("cls", "code", one.alias("s")), ["cls"], ["code", "s"], F.octet_length("s") + 2, budget)
    out = sections.groupBy("cls", "part_no").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("_id", "s"))).alias("r"))
    n = F.sum("_n").over(Window.partitionBy("cls"))  # a row for each part
    first = F.min("part_no").over(Window.partitionBy("cls")) == F.col("part_no")
    head = F.when(first, F.concat(F.lit("# "), "cls", F.lit("（"), n.cast("string"), F.lit("条）\n\n"))).otherwise("")
    return out.select("cls", "part_no", n.alias("n"), F.concat(head, F.array_join(F.transform("r", lambda x: x["s"]), "\n\n")).alias("text"))


def ingest_report(chapters: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, chapters, sections, passages, chars; with columns ord and title in ``chapters`` also preview, the first 30 titles."""
    c = chapters.groupBy("doc_id").agg(F.count_if(F.col("level") == 1).alias("chapters"), F.count_if(F.col("level") == 2).alias("sections"))
    p = passages.groupBy("doc_id").agg(F.count("*").alias("passages"), F.sum(F.length("content")).alias("chars"))
    out = c.join(p, "doc_id", "left").fillna(0, ["passages", "chars"])
    if not {"ord", "title"} <= set(chapters.columns):
        return out
    first = top(chapters.select("doc_id", "ord", "title"), ["doc_id"], [F.col("ord")], 30)
    titles = first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("preview"))
    return out.join(titles, "doc_id", "left")
