"""Passages of the line table against a plain fold, over ranges that cut documents and blocks, and the odd cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lorebase.operators import common, structure


def brute(lines: list[tuple]) -> list[tuple]:
    docs: dict = {}
    for doc, no, page, text in lines:
        if doc is not None and no is not None:
            docs.setdefault(doc, []).append((no, page, (text or "").strip(" \t\n\r\f\v")))
    out = []
    for doc, rows in docs.items():
        rows.sort(key=lambda r: r[0])
        blocks, now = [], []
        for r in [*rows, (0, 0, "")]:
            if r[2]:
                now.append(r)
            elif now:
                blocks.append(now)
                now = []
        found = []
        for b in blocks:
            text = " ".join(r[2] for r in b)
            if len(text) <= 800:
                found += [(b[0][1], text)] * (len(text) >= 20)
                continue
            buffer = ""
            for part in re.split(r"(?<=[。；;！？!?])\s*", text, flags=re.ASCII):
                if len(buffer) + len(part) > 500 and len(buffer) >= 50:
                    found.append((b[0][1], buffer.strip(" ")))
                    buffer = part
                else:
                    buffer += part
            found += [(b[0][1], buffer.strip(" "))] * (len(buffer.strip(" ")) >= 20)
        out += [(doc, i, *f) for i, f in enumerate(found)]
    return sorted(out)


def test_passages_match_a_plain_fold(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abc病痛。!; ") for _ in range(rng.randint(1, 60)))
    lines = [(d, i, i // 9, rng.choice(["", "  ", None]) if rng.random() < 0.15 else word()) for d, n in ((1, 900), (2, 1), (3, 40), (4, 300), (5, 0)) for i in range(n)]
    lines += [(6, i, 1, "no end of a sentence here") for i in range(200)] + [(7, 2**40, None, "x" * 3000), (8, 0, 0, "x" * 19), (9, 0, 0, "x" * 20), (None, 1, 1, "w" * 30), (9, None, 1, "w" * 30)]
    rng.shuffle(lines)
    df = spark.createDataFrame(lines, "doc_id long, line_no long, page_no int, text string").repartition(3)
    got = structure.passages_of_lines(df)
    assert sorted(tuple(r) for r in got.collect()) == brute(lines)
    assert structure.passages_of_lines(df.limit(0)).collect() == []


def test_numbers_of_a_group_over_many_ranges(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), F.hash("id").alias("x"), "id")
    got = common.numbered(df, ["g"], ["x", "id"], "n").collect()
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.g, r.x, r.id)):
        assert r.n == by.setdefault(r.g, 0)
        by[r.g] += 1
    assert sum(by.values()) == 3000


def test_parts_keep_to_their_budget(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else str(i % 5), i, "x" * rng.randint(0, 40)) for i in range(2000)] + [("big", 1, "y" * 500), ("big", 2, "z"), (None, 1, "n"), ("null", 1, None), ("null", 2, "a")]
    got = common.part_numbers(spark.createDataFrame(rows, "g string, id int, t string"), ["g"], ["id"], F.octet_length("t"), 100).collect()
    want: dict = {}
    total: dict = {}
    for g, i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1])):
        want[g, i] = total.get(g, 0) // 100
        total[g] = total.get(g, 0) + len(t or "")
    assert {(r.g, r.id): r.part_no for r in got} == want and len(got) == len(want)
