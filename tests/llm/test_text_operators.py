"""Operators on whole texts, against brute force, libraries and round trips."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorebase.llm import bpe, fingerprints, media, mixing, ngram_join, suffix_dedup, token_counts
from lorebase.llm.shingles import shingle_set
from tests.llm.conftest import rows, words


def brute_dedup(docs: list[tuple[int, bytes]], least: int) -> list[tuple]:
    """(n_removed, n_spans, kept) of documents in order; equal ids are not earlier than one another."""
    seen: dict[bytes, tuple] = {}
    for i, b in docs:
        for s in range(len(b) - least + 1):
            w = b[s : s + least]
            if w not in seen or (i, s) < seen[w]:
                seen[w] = (i, s)
    out = []
    for i, b in docs:
        gone = bytearray(len(b))
        for s in range(len(b) - least + 1):
            if seen[b[s : s + least]] < (i, s):
                gone[s : s + least] = b"\1" * least
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def test_suffix_dedup_matches_brute_force(docs, empty, monkeypatch):
    want = {}
    data = [((1 << 62) if r[0] is None else r[0], (r[1] or "").encode()) for r in rows()]
    unique = sorted(set(data))
    for (i, b), (n, spans, kept) in zip(unique, brute_dedup(unique, 100), strict=True):
        want[i] = (len(b), n, spans, hashlib.sha256(kept).hexdigest())
    for small in (False, True):
        if small:  # batches and groups cut often
            monkeypatch.setattr(suffix_dedup, "CONTEXTS", 5)
            monkeypatch.setattr(suffix_dedup, "HELD", 7)
        got = suffix_dedup.dedup_digests(docs).collect()
        assert len(got) == len(data)
        for r in got:
            assert tuple(r)[1:] == want[(1 << 62) if r.doc_id is None else r.doc_id], r.doc_id
    assert suffix_dedup.dedup_digests(empty).collect() == []


def test_long_texts_are_anchored_in_pieces(monkeypatch):
    text = hashlib.shake_256(b"x").digest(9000)
    whole = suffix_dedup.anchors([text], 100)[0]
    monkeypatch.setattr(suffix_dedup, "TEXT", 1000)
    pieces = suffix_dedup.anchors([text], 100)[0]
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()


def test_interval_tree():
    # Sorted suffixes of banana$: $ a$ ana$ anana$ banana$ na$ nana$
    found = sorted(suffix_dedup.lcp_intervals(np.array([0, 1, 3, 0, 0, 2]), 1))
    assert found == [(1, 3, 1), (2, 3, 3), (5, 6, 2)]


def test_texts_that_share_a_hash_are_told_apart(docs, monkeypatch):
    want = sorted(map(tuple, suffix_dedup.dedup_digests(docs).collect()), key=str)
    monkeypatch.setattr(suffix_dedup, "text_hash", lambda c: F.length(c).cast("long") % 3)
    assert sorted(map(tuple, suffix_dedup.dedup_digests(docs).collect()), key=str) == want


def brute_repeats(docs: list[tuple[int, bytes]], least: int) -> dict[bytes, set]:
    """Every string with a pair of occurrences that can be extended to neither side, with all its occurrences."""
    at: dict[bytes, list] = {}
    for i, b in docs:
        for p in range(len(b) - least + 1):
            at.setdefault(b[p : p + least], []).append((i, p))
    data, names = dict(docs), set()
    for places in at.values():
        for k, (i, p) in enumerate(places):
            for j, q in places[:k]:
                a, b = data[i], data[j]
                if p and q and a[p - 1] == b[q - 1]:
                    continue  # found from where it begins
                n = least
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n]:
                    n += 1
                names.add(a[p : p + n])
    return {s: {(i, p) for i, p in at[s[:least]] if data[i].startswith(s, p)} for s in names}


def test_maximal_repeats_have_all_occurrences(docs, empty):
    rng = random.Random(8)
    shared, inner = words(rng, 400), words(rng, 60)
    texts = [shared, "a " + shared + " b", shared[:1500], "z" + shared[700:] + inner, inner, inner + shared[700:], "x" * 250, "xy" * 90, inner, "q" + inner[:200] + inner[:200], "", None]
    data = [(i, t) for i, t in enumerate(texts)]
    df = docs.sparkSession.createDataFrame([*data, data[3]], "doc_id long, text string").repartition(3)
    want = brute_repeats([(i, (t or "").encode()) for i, t in data], 100)
    assert max(map(len, want)) > 1000 and len(want) > 20
    got: dict = {}
    for r in suffix_dedup.maximal_repeats(df, 100).collect():
        got.setdefault((r.repeat, r.n_bytes), []).append((r.doc_id, r.start, r.first))
    assert sorted(sorted((i, p) for i, p, _ in g) for g in got.values()) == sorted(sorted(g) for g in want.values())
    assert all(sum(f for *_, f in g) == 1 and min(g)[2] for g in got.values())
    assert suffix_dedup.maximal_repeats(empty, 100).collect() == []
    nulls = {r.doc_id for r in suffix_dedup.maximal_repeats(docs, 100).collect()}
    assert None in nulls


def test_cut_repeats_keeps_columns_and_characters(docs):
    out = suffix_dedup.cut_repeats(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        if r.text is not None:
            assert r.n_chars == len(r.text)


def test_bpe_equals_the_library(docs, empty):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["it's  we'll\n\n x", " a", "1½ ٣٤", "<|endoftext|>a<|endoftext|>", "a\x1cb\x85c　d", "aaaa" * 50, "😀é", "'s'S"]
    spark = docs.sparkSession
    more = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(odd)], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").unionByName(more)
    want = {}
    for i, x in [(r[0], r[1]) for r in rows()] + [(1000 + i, x) for i, x in enumerate(odd)]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    for r in bpe.encode_digests(all_docs).collect():
        assert tuple(r)[1:] == want[r.doc_id]
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(all_docs)).collect()}
    assert all(back[i] == (x or "") for i, x in enumerate(odd, 1000))
    assert bpe.encode_digests(empty).collect() == []


def test_token_counts(docs, empty):
    lengths = [r.n_tokens for r in bpe.count_tokens(docs).collect()]
    got = {r.n_tokens: r for r in token_counts.token_counts(docs).collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert r.n_docs == lengths.count(n) and r.docs_at_least == sum(x >= n for x in lengths) and r.tokens_at_least == sum(x for x in lengths if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lengths) and r.lost_tokens == sum(lengths) - r.truncated_total
    limits = docs.sparkSession.createDataFrame([(0,), (7,), (100,), (10**6,)], "n_tokens long")
    hist = token_counts.length_histogram(bpe.count_tokens(docs))
    assert {r.n_tokens: r.truncated_total for r in token_counts.at_limits(hist, limits).collect()} == {n: sum(min(x, n) for x in lengths) for n in (0, 7, 100, 10**6)}
    assert token_counts.token_counts(empty).collect() == []


def test_media_round_trip(docs, empty):
    texts = {r[0]: (r[1] or "").encode() for r in rows()}
    got = media.store_and_read(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        payload = media.pad(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.encode_png(payload)), hashlib.sha256(media.encode_png(payload)).hexdigest())
    assert media.store_and_read(empty).collect() == []


def test_a_damaged_member_harms_no_other(docs, tmp_path):
    path = f"file://{tmp_path}/media"
    n = media.write_archives(docs.coalesce(1), path)
    archive = next((tmp_path / "media").glob("*.zip"))
    data = bytearray(archive.read_bytes())
    at = data.find(media.PNG_SIGNATURE, 2000)
    data[at + 60] ^= 255
    archive.write_bytes(bytes(data))
    got = media.read_archives(docs.sparkSession, path).collect()
    assert len(got) == n and sum(r.error is not None for r in got) == 1


def test_archives_of_lost_attempts_are_not_read(docs, tmp_path):
    path = f"file://{tmp_path}/media"
    n = media.write_archives(docs, path)
    archives = sorted((tmp_path / "media").glob("*.zip"))
    (tmp_path / "media" / ("part-000000-" + "0" * 32 + "-0000.zip")).write_bytes(archives[0].read_bytes())
    (tmp_path / "media" / "part-000001-half.zip").write_bytes(archives[0].read_bytes()[:99])
    small = docs.sparkSession.read.format("media_archive").option("rangeBytes", 500).load(path)
    for got in (media.read_archives(docs.sparkSession, path), small):
        assert got.count() == n == len(rows()) and got.where("error IS NOT NULL").count() == 0


def test_png_is_read_by_its_rules():
    samples = bytes(range(256))
    assert media.decode_png(media.encode_png(samples)).tobytes() == samples
    with pytest.raises(ValueError):
        media.decode_png(b"no image")


def brute_simhash(text: str) -> int:
    found = [w for w in re.split("[ \\x09-\\x0d]+", text.lower()) if w]
    hashes = []
    for i, w in enumerate(found):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        hashes.append(xxhash.xxh64_intdigest(found[i - 1].encode(), h) if i else h)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, empty):
    got = fingerprints.fingerprint_edits(docs, search_every=6).collect()
    data = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in data]
    fps = [brute_simhash(x) for x in texts]
    like = lambda a, b: 1 - bin(a ^ b).count("1") / 64
    want = []
    for i, (r, x) in enumerate(zip(data, texts, strict=True)):
        after, n = texts[(i + 1) % len(texts)], len(x) // 4
        edited = x[: len(x) - n] + after[:n]
        near = sum(bin(f ^ fps[i]).count("1") <= 3 for f in fps) - 1 if r[0] is not None and r[0] % 6 == 0 else None
        want.append((r[0], len(x), hashlib.sha256(edited.encode()).hexdigest(), f"{fps[i]:016x}", f"{brute_simhash(edited):016x}", like(fps[i], brute_simhash(edited)), like(fps[i], fps[(i + 1) % len(fps)]), near))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert fingerprints.fingerprint_edits(empty).collect() == [] and fingerprints.fingerprint_edits(empty, search_every=20).collect() == []


def test_votes_of_long_texts(spark, monkeypatch):
    one = spark.createDataFrame([("a b c d e f g " * 9,)], "text string")
    monkeypatch.setattr(fingerprints, "BLOCK", 65_535)
    whole = fingerprints.with_fingerprint(one, "text", "fp").first().fp
    monkeypatch.setattr(fingerprints, "BLOCK", 10)
    assert fingerprints.with_fingerprint(one, "text", "fp").first().fp == whole


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63, 40)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(4)]
    fps = [int(b) for b in base] + near
    df = spark.createDataFrame([(x,) for x in fps] + [(None,)], "fp long")
    got = {(r.query_fp, r.stored_fp): r.distance for r in fingerprints.within_radius(df, df, 3).collect()}
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert got == {(a, b): dist(a, b) for a in set(fps) for b in set(fps) if a != b and dist(a, b) <= 3}


def brute_components(docs: list[tuple], width: int, percent: int) -> dict:
    sets = [set(shingle_set(t, width).tolist()) for _, t in docs]
    comp = list(range(len(docs)))
    root = lambda x: x if comp[x] == x else root(comp[x])
    for i in range(len(docs)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    members: dict = {}
    for i in range(len(docs)):
        members.setdefault(root(i), []).append(docs[i][0])
    return {(docs[i][0], docs[i][1]): (len(sets[i]), min((x for x in members[root(i)] if x is not None), default=None)) for i in range(len(docs))}


@pytest.mark.parametrize(("width", "percent", "block"), [(4, 85, 1024), (5, 80, 1), (2, 50, 2)])
def test_ngram_join_matches_brute_force(spark, docs, empty, monkeypatch, width, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(width)
    more, base = [], [f"w{rng.randint(0, 400)}" for _ in range(60)]
    for i in range(40):  # a chain of edits: neighbours link, ends do not
        base[rng.randrange(60)] = f"v{i}"
        more.append((500 + i, " ".join(base[: 60 - i % 4])))
    data = [(r[0], r[1]) for r in rows()] + more
    all_docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_components(data, width, percent)
    ids: dict = {}
    for (i, _), x in want.items():
        ids.setdefault(i, set()).add(x)
    got = ngram_join.near_duplicates(all_docs, width, percent).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r.n_shingles, r.component_id) in ids[r.doc_id]
    assert ngram_join.near_duplicates(empty, width, percent).collect() == []


def test_keep_one_keeps_columns(docs):
    out = ngram_join.keep_one(docs, 5, 80)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert 0 in kept and 3 not in kept and 6 not in kept and 24 in kept
    assert None not in kept and kept.count(12) == 1  # the row without an id is a near copy of row 0, row 12 is there twice


def test_targets_fill_like_water(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, "d": 0, None: 90}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    order = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    want, clamped = {}, set()
    while True:  # clamp what is above, share the rest again
        rest = sum(sizes.values()) - sum(3 * sizes[k] for k in clamped)
        free = [k for k in order if k not in clamped]
        want = {k: 3.0 * sizes[k] if k in clamped else rest * weight[k] / sum(weight[x] for x in free) for k in order}
        above = {k for k in free if want[k] > 3 * sizes[k]}
        if not above:
            break
        clamped |= above
    assert got == pytest.approx(want)


def test_mixing(docs, empty):
    got = mixing.mix_sizes(docs).collect()
    assert len(got) == len(rows())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sizes(docs.repartition(5)).collect()), key=str)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r["size"] for r in mine)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.repeats for r in got)
    assert mixing.mix_sizes(empty).collect() == [] and mixing.mix(empty).collect() == []
