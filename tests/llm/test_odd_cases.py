"""Cases at the edge of the operators: odd limits, unknown ids, reads that fail once, the pipeline as a whole."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lorebase.llm import bpe, media, mixing, ngram_join, suffix_dedup, token_counts, toxicity
from tests.llm.conftest import rows

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_limits_that_are_none(spark):
    hist = spark.createDataFrame([(3, 2), (10, 1)], "n_tokens long, n_docs long")
    limits = spark.createDataFrame([(None,), (-1,), (0,), (5,), (5,)], "n_tokens long")
    assert {tuple(r) for r in token_counts.at_limits(hist, limits).collect()} == {(0, 0), (5, 11)}


def test_unknown_ids_fail(spark):
    good = spark.createDataFrame([(1, [0, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text is None for r in bpe.decode(good).collect()} == {1: False, 2: True, 3: False}
    with pytest.raises(Exception, match="IndexError|KeyError"):
        bpe.decode(spark.createDataFrame([(1, [10_000_000])], "doc_id long, ids array<int>")).collect()


class Flaky:
    """A file whose reads fail a number of times, and the file system that opens it."""

    def __init__(self, data: bytes, failures: int) -> None:
        self.data, self.failures, self.opened = data, failures, 0

    def open_input_file(self, path: str):  # noqa: ARG002
        self.opened += 1
        outer, inner = self, pa.PythonFile(io.BytesIO(self.data), "r")

        class File:
            def __getattr__(self, name: str):
                return getattr(inner, name)

            def read_at(self, n: int, at: int) -> bytes:
                if outer.failures:
                    outer.failures -= 1
                    raise OSError("lost")
                inner.seek(at)
                return inner.read(n)

        return File()


@pytest.mark.parametrize("failures", [0, 1, 3, 4])
def test_a_member_is_read_again_after_failures(failures):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            info = zipfile.ZipInfo(f"{i}.png")
            info.comment = b"1,2"
            z.writestr(info, media.encode_png(media.pad(bytes([i]) * 70)))
    files = Flaky(sink.getvalue(), failures)
    reader = media.MediaReader({"path": "/tmp", "retries": 3})
    batches = list(reader._members(media.ByteRange("a/b.zip", 0, len(sink.getvalue())), media.Archive(files, "a/b.zip")))
    got = [r for b in batches for r in b.to_pylist()]
    assert len(got) == 3 and [r["error"] is None for r in got] == [failures < 4, True, True]
    assert files.opened == 1 + min(failures, 4)
    assert [r["payload"] for r in got if not r["error"]] == [media.pad(bytes([i]) * 70) for i in range(3) if i or failures < 4]


def test_the_pipeline_is_its_stages_one_after_the_other(spark, tmp_path):
    """run() over tables in files equals the operators applied to one another, without what it writes between."""
    data = [(i, t, "en", s, n) for i, t, _, s, n, *_ in rows() if i is not None]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i, *_ in data], "doc_id long, quality int, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    kept = toxicity.drop_toxic(docs, labels)
    once = mixing.mix(suffix_dedup.cut_repeats(ngram_join.keep_one(kept, width=5, percent=80)))
    want = bpe.encode(once)
    flat = lambda df: sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in df.collect())
    assert got.columns == want.columns and flat(got) == flat(want) and got.count() > 5
    assert once.select(F.count_if(F.col("text").isNull())).first()[0] <= docs.where("text IS NULL").count() * 3
