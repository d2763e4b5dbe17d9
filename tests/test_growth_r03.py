"""Work that once grew faster than its rows, or was held for longer than needed: the same results from less."""

from __future__ import annotations

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from lorebase.operators import dataset, segmenter
from lorebase.plans import QUERIES, text_queries
from lorebase.sources import io


def rewritten(text: str | None) -> str | None:
    """Brute force of D12."""
    number, bullet = r"\d+[.、]\s*(.+)", r"[-•]\s*(.+)"
    if text is None:
        return None
    lines = [x for x in (line.strip(" ") for line in re.split("\r?\n", text)) if x]
    n = 0
    while n < len(lines) and (re.fullmatch(number, lines[-1 - n]) or re.fullmatch(bullet, lines[-1 - n])):
        n += 1
    head, block = lines[: len(lines) - n], lines[len(lines) - n :]
    if not n:
        return None
    if all(re.fullmatch(number, x) for x in block):
        return "\n".join([*head, *("- " + re.fullmatch(number, x)[1].strip(" ") for x in block)])
    if not all(re.fullmatch(bullet, x) for x in block) or len(head) > 1 or (head and not head[0].endswith("：")):
        return None
    joined = "；".join(re.fullmatch(bullet, x)[1].strip(" ") for x in block)
    return "".join(head) + (joined if joined[-1:] in ("。", "；") else joined + "。")


def test_rewrite_output_computes_its_lines_once(spark):
    rng = random.Random(4)
    pieces = ["1. a", "2、 b c", "- d", "• e。", "-", "text", "intro：", "", "  ", " 3. f ", "- g；"]
    texts = [None, "", *("\n".join(rng.choice(pieces) for _ in range(rng.randint(1, 5))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, output string").withColumn("input", F.lit("甲有哪些？"))
    got = {r.id: r.r for r in df.select("id", dataset.rewrite_output(F.col("output")).alias("r")).collect()}
    assert got == {i: rewritten(t) for i, t in enumerate(texts)} and any(got.values())
    out = dataset.augment(df)
    kinds = {(r.id, r.kind): (r.input, r.output) for r in out.collect()}
    want = {(i, k): v for i, t in enumerate(texts) for k, v in (("original", ("甲有哪些？", t)), ("question", ("甲包括哪些？", t)), ("output", ("甲有哪些？", rewritten(t)))) if k != "output" or rewritten(t) is not None}
    assert kinds == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1  # many times before, and computed at each


def test_json_maps_are_lines_of_few_files(spark, tmp_path, monkeypatch):
    (tmp_path / "m.json").write_text('{"a": {"n": 1}, "b": {"n": 2}}\n\n{"c": {"n": 3}}\n')
    assert {(r.key, r.n) for r in io.read_json_map(spark, str(tmp_path / "m.json"), "struct<n:int>", one_a_line=True).select("key", "value.n").collect()} == {("a", 1), ("b", 2), ("c", 3)}
    monkeypatch.setattr(text_queries, "_folder", lambda _, what: str(tmp_path / what))
    got = QUERIES["read_json_map"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.key for r in got}) == len(got) == spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").count()
    assert len(list((tmp_path / "map").rglob("part-*"))) <= 4  # a file for each ten suppliers before


def test_segment_passes_terms_on_slice_by_slice(spark, monkeypatch):
    monkeypatch.setattr(segmenter, "CHARS", 10)
    real = spark.createDataFrame([("急性",)], "text string")

    class Caught:
        columns, schema, sparkSession = real.columns, real.schema, spark

        def mapInArrow(self, run, _):
            self.run = run

    caught, texts = Caught(), ["急性心衰", None, "心衰" * 8, "", *["急性"] * 20]
    segmenter.segment(caught, {"急性": 5, "心衰": 9})
    out = list(caught.run(iter([pa.RecordBatch.from_pydict({"text": texts})])))
    assert len(out) > 4  # one before
    assert pa.Table.from_batches(out).to_pylist() == [{"text": t, "terms": [w for w in ("急性", "心衰") if w in (t or "")]} for t in texts]
