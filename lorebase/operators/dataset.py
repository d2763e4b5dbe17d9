"""D: building, augmenting, checking and splitting training data."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorebase.functions.text import clean_title, meaningful_title
from lorebase.operators.common import seeded, top
from lorebase.workers import stored

# Question patterns in order, and what each becomes ($1 before, $2 after the asked part).
QUESTION_FORMS = (
    ("^(.+?)(?:的)?典型临床表现是什么[?？]?$", "$1的典型临床表现包括哪些内容？"),
    ("^(.+?)多重用药的界定标准是什么[?？]?$", "$1多重用药的界定标准包括哪些内容？"),
    ("^(.+?)的推荐是什么[?？]?$", "$1的建议包括哪些？"),
    ("^(.+?)的诊断标准是什么[?？]?$", "$1的诊断标准包括哪些？"),
    ("^(.+?)的界定标准是什么[?？]?$", "$1的界定标准包括哪些内容？"),
    ("^(.+?)的标准是什么[?？]?$", "$1的标准包括哪些内容？"),
    ("^(.+?)分别是什么[?？]?$", "$1分别包括哪些？"),
    ("^(.+?)是什么[?？]?$", "$1包括哪些内容？"),
    ("^(.+?)有哪些[?？]?$", "$1包括哪些？"),
    ("^(.+?)包括哪些[?？]?$", "$1有哪些？"),
    ("^(.+?)有哪几(?:类|种)[?？]?$", "$1分为哪几类？"),
    ("^(.+?)有什么作用[?？]?$", "$1的作用包括哪些？"),
    ("^(.+?)有什么限制[?？]?$", "$1的限制包括哪些？"),
    ("^(.+?)有何临床获益[?？]?$", "$1的临床获益包括哪些？"),
    ("^(.+?)有哪些临床获益[?？]?$", "$1的临床获益包括哪些？"),
    ("^(.+?)的临床获益有哪些[?？]?$", "$1有哪些临床获益？"),
    ("^(.+?)有何区别[?？]?$", "$1有什么区别？"),
    ("^(.+?)包括哪几(?:种|类)类型[?？]?$", "$1分为哪几种？"),
    ("^(.+?)分别是多少[?？]?$", "$1各是多少？"),
    ("^(.+?)是多少[?？]?$", "$1分别是多少？"),
    ("^(.+?)是怎样的[?？]?$", "$1是什么？"),
    ("^(.+?)宜选用哪类(.+?)[?？]?$", "$1应该选用哪一类$2？"),
    ("^(.+?)需要覆盖哪些(.+?)[?？]?$", "$1应覆盖哪些$2？"),
    ("^(.+?)能发挥什么作用[?？]?$", "$1能发挥哪些作用？"),
    ("^(.+?)应遵循什么原则[?？]?$", "$1应遵循哪些原则？"),
    ("^(.+?)哪个(.+?)[?？]?$", "$1哪一个$2？"),
    ("^(.+?)可能导致哪些(.+?)[?？]?$", "$1可能带来哪些$2？"),
    ("^(.+?)有哪些影响[?？]?$", "$1的影响包括哪些？"),
    ("^(.+?)属于哪一类(.+?)[?？]?$", "$1属于哪个类别$2？"),
    ("^(.+?)有何特点[?？]?$", "$1的特点包括哪些？"),
    ("^(.+?)是否存在显著差异[?？]?$", "$1是否存在明显差异？"),
    ("^(.+?)具有怎样的(.+?)[?？]?$", "$1的$2如何？"),
    ("^(.+?)能否(.+?)[?？]?$", "$1是否可用于$2？"),
    ("^(.+?)应出现哪些(.+?)[?？]?$", "$1会出现哪些$2？"),
    ("^(.+?)主要依据哪些(.+?)[?？]?$", "$1依据哪些$2？"),
    ("^(.+?)需要考虑哪些(.+?)[?？]?$", "$1需考虑哪些$2？"),
    ("^如何(.+?)[?？]?$", "应该怎样$1？"),
    ("^怎么(.+?)[?？]?$", "应如何$1？"),
    ("^(.+?)[应，,、]*如何(.+?)[?？]?$", "$1应该怎样$2？"),
    ("^为什么(.+?)[?？]?$", "$1的原因是什么？"),
)
DEFAULT_SYSTEM = "你是一个专业的助手。"


def gen_questions(title: Column) -> Column:
    """Array of (category, question) for a title: one for examinations, one for criteria or treatment, else two."""
    ask = lambda kind, end: F.struct(F.lit(kind).alias("category"), F.concat(title, F.lit(end)).alias("question"))
    exam, points = title.rlike("检查|检验|CT|X线|B超|超声|解读"), title.rlike("诊断标准|标准|选择|方案|用药|治疗|分级|分类|原则")
    kind = F.when(title.rlike("诊断|标准|分级|分类"), "diagnosis").otherwise("treatment")
    one = F.struct(kind.alias("category"), F.concat(title, F.lit("有哪些要点？")).alias("question"))
    return F.when(exam, F.array(ask("diagnosis", "的临床意义是什么？"))).when(points, F.array(one)).otherwise(F.array(ask("diagnosis", "的诊断标准是什么？"), ask("treatment", "的治疗原则是什么？")))


def golden_questions(leaves: DataFrame, passages: DataFrame, cap: int = 6) -> DataFrame:
    """Id, book_id, book_title, chapter, category, question: leaf chapters with a passage and a meaningful title, a chapter taken while its book has under ``cap`` questions; level-1 ones name the book."""
    with_text = leaves.join(passages.where("enabled").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    named = with_text.withColumn("clean", clean_title(F.col("title"))).where(meaningful_title(F.col("clean")))
    asked = named.withColumn("q", gen_questions(F.col("clean")))
    upto = F.sum(F.size("q")).over(Window.partitionBy("book_id").orderBy("id"))
    taken = asked.withColumn("_before", upto - F.size("q")).where(F.col("_before") < cap)
    rows = taken.select("book_id", "book_title", F.col("id").alias("chapter_id"), F.col("clean").alias("chapter"), "level", F.posexplode("q").alias("pos", "x"))
    text = F.when(F.col("level") == 1, F.concat(F.lit("《"), "book_title", F.lit("》"), "x.question")).otherwise(F.col("x.question"))
    rows = rows.select("book_id", "book_title", "chapter_id", "pos", "chapter", F.col("x.category").alias("category"), text.alias("question"))
    per = rows.groupBy("book_id").agg(F.count("*").alias("n"))  # ids run on from book to book: one row per book in the first window
    start = per.withColumn("_start", F.sum("n").over(Window.orderBy("book_id")) - F.col("n")).select("book_id", "_start")
    place = F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_id", "pos"))
    return rows.join(start, "book_id").select((F.col("_start") + place).alias("id"), "book_id", "book_title", "chapter", "category", "question")


def append_new_questions(old: DataFrame, new: DataFrame) -> DataFrame:
    """D3: ``old`` (id, question) and the new questions (ord, question) not in it, first of equal ones, ids continued.

    New questions are dealt in ranges of (ord, question) and numbered in each; one row per range says where its ids begin.
    """
    last = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last")).first()["last"]
    fresh = new.join(old.select("question"), "question", "left_anti").groupBy("question").agg(F.min("ord").alias("ord"))
    dealt = stored(fresh.repartitionByRange("ord", "question").withColumn("_part", F.spark_partition_id()), "new-questions")
    per = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    start = per.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n") + last).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("ord", "question"))
    numbered = dealt.withColumn("_place", place).join(start, "_part").select((F.col("_start") + F.col("_place")).alias("id"), "question")
    return old.select("id", "question").unionByName(numbered)


def rule_qa(rules: DataFrame, templates: Sequence[str]) -> DataFrame:
    """Question, answer of every rule (code, name, body) with a body for each template (%s: name)."""
    asked = F.array(*(F.format_string(t, F.col("name")) for t in templates))
    return rules.where(F.length("body") > 0).select("code", F.explode(asked).alias("question"), F.concat(F.lit("【"), "name", F.lit("】\n"), "body").alias("answer"))


def checklist_qa(items: DataFrame) -> DataFrame:
    """Two questions per item (code, name, points, exempt) with points; exemptions follow."""
    answer = F.concat("points", F.when(F.length("exempt") > 0, F.concat(F.lit("\n豁免："), F.col("exempt"))).otherwise(""))
    asked = F.array(F.concat(F.col("code"), F.lit(" "), "name", F.lit("的判定要点是什么？")), F.concat(F.col("name"), F.lit("如何判定？")))
    return items.where(F.length("points") > 0).select("code", F.explode(asked).alias("question"), answer.alias("answer"))


def sample_passages(passages: DataFrame, n: int = 1200, k: int = 200, pattern: str = ".", skip_books: Sequence[str] = (), seed: int = 7) -> DataFrame:
    """Of n passages first in a seeded hash order, outside the skipped books, those that match, k at most."""
    p = passages.where(~F.col("book").isin(*skip_books)) if skip_books else passages
    order = seeded(seed, "id")
    return p.orderBy(order, "id").limit(n).where(F.col("content").rlike(pattern)).orderBy(order, "id").limit(k)


def union_qa(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """First row per question over the parts (ord, question, answer) in order, with its part."""
    out = None
    for i, (name, df) in enumerate(parts):
        rows = df.select("question", "answer", "ord", F.lit(i).alias("_i"), F.lit(name).alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return top(out, ["question"], [F.col("_i"), F.col("ord")], 1).drop("_i", "ord")


def rag_contexts(chapters: DataFrame, passages: DataFrame, n: int = 3, cut: int = 400) -> DataFrame:
    """doc_id, title, context: the first passages of chapters with titles of 2 to 20 characters, each cut, as numbered references."""
    first = top(passages.where("enabled").select("id", "doc_id", F.left("content", F.lit(cut)).alias("content")), ["doc_id"], [F.col("id")], n, "rank")
    rows = F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("【参考"), F.col("rank").cast("string"), F.lit("】"), "content").alias("line"))))
    text = first.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("context"))
    return chapters.where(F.length("title").between(2, 20)).select(F.col("id").alias("doc_id"), "title").join(text, "doc_id")


def rag_samples(contexts: DataFrame, qa: DataFrame, instruction: str) -> DataFrame:
    """Instruction, input, output for questions of 5 and answers of 20 characters or more (doc_id, question, answer)."""
    out = contexts.join(qa, "doc_id").where((F.length("question") >= 5) & (F.length("answer") >= 20))
    return out.select(F.lit(instruction).alias("instruction"), F.concat("context", F.lit("\n\n问题："), "question").alias("input"), F.col("answer").alias("output"))


def triplets(chapters: DataFrame, passages: DataFrame, seed: int = 7) -> DataFrame:
    """Query, positive, negatives: a chapter's title with each of its first two passages, one passage of another chapter of the book and two of other books.

    Pools are numbered by a seeded hash, per book and in all by hash slot, so a negative is fetched by an
    equi-join on its number; a slot that falls on the chapter or book itself takes the next.
    """
    text = passages.where(F.length("content") >= 20).join(chapters.select(F.col("id").alias("doc_id"), "book_id", "title"), "doc_id").select("id", "doc_id", "book_id", "title", "content")
    ready = text.withColumn("query", clean_title(F.col("title"))).where(F.length("query").between(2, 15))
    positive = top(ready, ["doc_id"], [F.col("id")], 2, "nth")
    pool = top(text, ["doc_id"], [seeded(seed, "id"), F.col("id")], 1)
    ring = Window.partitionBy("book_id").orderBy(seeded(seed, "doc_id"), "doc_id")
    in_book = pool.withColumn("slot", F.row_number().over(ring) - 1).withColumn("n", F.count("*").over(Window.partitionBy("book_id")))
    near = in_book.select("book_id", "slot", F.col("content").alias("near"))
    mine = in_book.where("n > 1").select("doc_id", "book_id", F.pmod(F.col("slot") + 1, F.col("n")).alias("slot")).join(near, ["book_id", "slot"]).select("doc_id", "near")
    books = top(pool, ["book_id"], [seeded(seed + 1, "id"), F.col("id")], 2, "part")
    order = Window.orderBy(seeded(seed, "book_id"), "book_id")  # one row per book
    numbered = books.where("part = 1").withColumn("b", F.row_number().over(order) - 1).select("book_id", "b")
    total = max(1, numbered.agg(F.count("*").alias("total")).first()["total"])
    far = books.where("part = 1").join(numbered, "book_id").select("b", F.col("content").alias("far"))
    away = numbered.select("book_id", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.pmod(F.col("b") + i, F.lit(total)).alias("b")) for i in (1, 2)))).alias("x")).select("book_id", "x.i", "x.b").join(far, "b")
    away = away.join(numbered.select(F.col("book_id").alias("_own"), "b"), "b").where("_own <> book_id").groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("i", "far"))).alias("fars"))
    out = positive.join(mine, "doc_id", "left").join(away, "book_id", "left")
    fars = F.coalesce(F.transform("fars", lambda f: f["far"]), F.array().cast("array<string>"))
    return out.select("query", F.col("content").alias("positive"), F.array_compact(F.concat(F.array("near"), fars)).alias("negatives"))


def question_triplets(questions: DataFrame, chapters: DataFrame, passages: DataFrame, seed: int = 7) -> DataFrame:
    """Query, positive, negatives of golden questions (question, book_title, chapter): the chapter's first passage, and two of other books.

    chapters(id, book_id, book_title, title); a chapter is found by its clean title and its book's. Negatives are the first
    passages, in a seeded hash order, of the two books that follow in such an order; one book has none.
    """
    known = chapters.select(F.col("id").alias("doc_id"), "book_id", "book_title", clean_title(F.col("title")).alias("chapter"))
    text = passages.where(F.length("content") >= 20).join(known.select("doc_id", "book_id"), "doc_id").select("id", "doc_id", "book_id", "content")
    one = top(known, ["book_title", "chapter"], [F.col("doc_id")], 1)
    asked = questions.select("question", "book_title", "chapter").join(one, ["book_title", "chapter"]).join(top(text.drop("book_id"), ["doc_id"], [F.col("id")], 1), "doc_id")
    first = top(text, ["book_id"], [seeded(seed, "id"), F.col("id")], 1)
    ring = first.withColumn("b", F.row_number().over(Window.orderBy(seeded(seed, "book_id"), "book_id")) - 1).select("book_id", "b", F.col("content").alias("far"))  # one row per book
    total = max(1, ring.count())
    others = ring.select("book_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("i"), "b").select("book_id", "i", F.pmod(F.col("b") + F.col("i"), F.lit(total)).alias("b"))
    fars = others.join(ring.withColumnRenamed("book_id", "_of"), "b").where("_of <> book_id").groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "far"))), lambda x: x["far"]).alias("negatives"))
    return asked.join(fars, "book_id", "left").select(F.col("question").alias("query"), F.col("content").alias("positive"), F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once for a row, however often ``then`` names it; a plain column is computed at each place."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def rewrite_question(q: Column) -> Column:
    """By the first pattern that matches and changes the question, else null."""
    t = F.trim(q)
    tries = [F.when(t.rlike(p) & (F.regexp_replace(t, p, r) != t), F.regexp_replace(t, p, r)) for p, r in QUESTION_FORMS]
    return F.coalesce(*tries)


def rewrite_output(text: Column) -> Column:
    """A trailing list rewritten: numbered to dashes, plain bullets to a paragraph, an intro line ending in ： with bullets to one line; else null."""
    number, bullet = r"^\d+[.、]\s*(.+)$", r"^[-•]\s*(.+)$"

    def of_lines(lines: Column) -> Column:
        no_item = F.transform(F.reverse(lines), lambda x: (~(x.rlike(number) | x.rlike(bullet))).cast("int"))
        n = let(F.array_position(no_item, 1), lambda stop: F.when(stop == 0, F.size(lines)).otherwise(stop - 1).cast("int"))
        return let(n, lambda n: F.when(n > 0, let(F.struct(F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), n).alias("block"), F.slice(lines, F.lit(1), F.size(lines) - n).alias("head")), lambda x: of_block(x["block"], x["head"]))))

    def of_block(block: Column, head: Column) -> Column:
        joined = let(F.array_join(F.transform(block, lambda x: F.trim(F.regexp_extract(x, bullet, 1))), "；"), lambda j: F.when(j.rlike("[。；]$"), j).otherwise(F.concat(j, F.lit("。"))))
        dashes = F.array_join(F.concat(head, F.transform(block, lambda x: F.concat(F.lit("- "), F.trim(F.regexp_extract(x, number, 1))))), "\n")
        intro = (F.size(head) == 1) & F.get(head, F.lit(0)).endswith("：")
        of_bullets = F.when(F.size(head) == 0, joined).when(intro, F.concat(F.get(head, F.lit(0)), joined))
        return F.when(F.forall(block, lambda x: x.rlike(number)), dashes).when(F.forall(block, lambda x: x.rlike(bullet)), of_bullets)

    return let(F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), of_lines)


def augment(samples: DataFrame) -> DataFrame:
    """Kind (original, question, output) and the sample with its question or output rewritten, where they can be."""
    row = lambda kind, i, out: F.struct(F.lit(kind).alias("kind"), i.alias("input"), out.alias("output"))
    i, o = F.col("input"), F.col("output")
    new = F.struct(rewrite_question(i).alias("q"), rewrite_output(o).alias("o"))
    rows = let(new, lambda x: F.array_compact(F.array(row("original", i, o), F.when(x["q"].isNotNull(), row("question", x["q"], o)), F.when(x["o"].isNotNull(), row("output", i, x["o"])))))
    rest = [c for c in samples.columns if c not in ("input", "output")]
    return samples.select(*rest, F.inline(rows))


def augment_counts(augmented: DataFrame) -> DataFrame:
    """Samples per kind and the growth factor over the originals."""
    n = augmented.agg(F.count_if(F.col("kind") == "original").alias("originals"), F.count_if(F.col("kind") == "question").alias("questions"), F.count_if(F.col("kind") == "output").alias("outputs"), F.count("*").alias("samples"))
    return n.withColumn("growth", F.round(F.col("samples") / F.col("originals"), 2))


def judge_samples(claims: DataFrame, instruction: str = "请判断下面的说法是否正确，并说明理由。") -> DataFrame:
    """Instruction, input and output of (claim, verdict, reason)."""
    return claims.select(F.lit(instruction).alias("instruction"), F.concat(F.lit("说法：\n\n"), "claim").alias("input"), F.concat(F.lit("判定："), "verdict", F.lit("\n理由："), "reason").alias("output"))


def eval_overlap(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Training rows whose claim (text after the first blank line) is in the evaluation set (claim)."""
    claim = F.trim(F.when(F.instr("input", "\n\n") > 0, F.expr("substring(input, instr(input, '\n\n') + 2)")).otherwise(F.col("input")))
    return train.withColumn("claim", claim).join(evaluation.select(F.trim("claim").alias("claim")).distinct(), "claim", "left_semi")


def label_balance(samples: DataFrame) -> DataFrame:
    """Count, positives and negatives per part and in all (part null)."""
    return samples.rollup("part").agg(F.count("*").alias("n"), F.count_if(F.col("positive")).alias("positives"), F.count_if(~F.col("positive")).alias("negatives"))


def train_test_split(df: DataFrame, share: float = 0.1, seed: int = 7, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows by a seeded hash of the id; reruns agree."""
    drawn = F.conv(F.left(seeded(seed, id_col), F.lit(8)), 16, 10).cast("long")
    test = F.pmod(drawn, F.lit(10_000)) < int(share * 10_000)
    return df.where(~test), df.where(test)


def lab_flags(results: DataFrame, ranges: DataFrame) -> DataFrame:
    """report_id, text, abnormal, items: values over or under their range named in a sentence."""
    flag = F.when(F.col("value") > F.col("high"), "偏高").when(F.col("value") < F.col("low"), "偏低")
    rows = results.join(ranges, "item").withColumn("flag", flag)
    said = F.sort_array(F.collect_list(F.when(F.col("flag").isNotNull(), F.struct("item", F.concat("item", F.col("value").cast("string"), F.coalesce("unit", F.lit("")), F.lit("（"), "flag", F.lit("）")).alias("s")))))
    out = rows.groupBy("report_id").agg(said.alias("a"), F.count("*").alias("items"))
    text = F.when(F.size("a") > 0, F.concat(F.lit("异常项目共"), F.size("a").cast("string"), F.lit("项："), F.array_join(F.transform("a", lambda x: x["s"]), "，"), F.lit("。"))).otherwise("未见异常。")
    return out.select("report_id", text.alias("text"), F.size("a").alias("abnormal"), "items")


def to_messages(samples: DataFrame, default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """Adds messages: system, valid history turns, user, assistant."""
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    past = F.filter(F.coalesce("history", none), lambda h: h["role"].isin("user", "assistant", "system") & (F.length(F.trim(h["content"])) > 0)) if "history" in samples.columns else none
    system = F.coalesce(F.nullif(F.trim("instruction"), F.lit("")), F.lit(default_system))
    return samples.withColumn("messages", F.concat(F.array(msg("system", system)), past, F.array(msg("user", F.col("input")), msg("assistant", F.col("output")))))
