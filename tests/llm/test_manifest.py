"""The Merkle manifest against a plain one, its closed-form places, and the edge cases."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from lorebase.llm import manifest
from tests.llm.conftest import DOCS, rows


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(leaves: list[str]) -> list[list[str]]:
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def brute(docs: list[tuple]) -> list[tuple]:
    """docs: doc_id, source, lang, n_chars, text."""
    groups = {}
    for d in docs:
        groups.setdefault(d[2], []).append((d[0] is not None, d[0] or 0, leaf(*d), d))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(groups[x], key=lambda r: r[:3])]) for x in names}
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        for i, (_, _, h, d) in enumerate(sorted(groups[x], key=lambda r: r[:3])):
            hit = d[0] is not None and d[3] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            value, siblings = leaf(*d[:3], d[3] + 1, d[4]) if hit else h, []
            for tree, j in ((trees[x], i), (top, k)):
                for row in tree[:-1]:
                    run = row[j & ~1 : (j & ~1) + 2]
                    siblings += run[1 - (j & 1) :][:1] if len(run) == 2 else []
                    value = digest(*(value if n == (j & 1) else r for n, r in enumerate(run)))
                    j >>= 1
            out.append((d[0], h, trees[x][-1][0], top[-1][0], digest(*siblings), value, value == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", range(1, 40))
def test_places_are_those_of_a_postorder_walk(n):
    log, tree = manifest.append([digest(str(i)) for i in range(n)], (n - 1).bit_length()), levels([digest(str(i)) for i in range(n)])
    places = {manifest.position(lv, i, n): h for lv, row in enumerate(tree) for i, h in enumerate(row)}
    assert [places[k] for k in range(len(log))] == log and len(places) == len(log)
    for i in range(n):
        assert manifest.fold(tree[0][i], manifest.path("".join(log), i, n, (n - 1).bit_length())) == tree[-1][0]


@pytest.mark.parametrize("size", [1, 2, 10])
def test_proofs_match_a_plain_tree(docs, size):
    got = sorted((tuple(r) for r in manifest.tampered_proofs(docs, levels=size).collect()), key=str)
    assert got == brute([(r[0], r[3], r[2], r[4], r[1]) for r in rows()])


@pytest.mark.parametrize("size", [1, 3])
def test_several_trees_of_many_stages(spark, size):
    data = [(i, f"text {i % 11}", [None, "de", "en", "é", "zh"][min(4, i * i % 13)], "s", i % 9 or None, 1, 1, "a", "b") for i in range(300)]
    data += [(7, "same", "en", "s", 4, 1, 1, "a", "b")] * 40 + [(None, "no id", None, None, None, 1, 1, "a", "b")] * 3
    got = sorted((tuple(r) for r in manifest.tampered_proofs(spark.createDataFrame(data, DOCS).repartition(5), levels=size).collect()), key=str)
    want = brute([(r[0], r[3], r[2], r[4], r[1]) for r in data])
    assert got == want and 0 < sum(r[-1] for r in got) < len(got)


def test_one_row_and_none(spark, docs, empty):
    one = manifest.tampered_proofs(docs.where("doc_id = 3").limit(1)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == digest()
    assert manifest.tampered_proofs(empty).collect() == []
