"""BPE encoding and decoding: batched merge rounds in numpy over the words of many texts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import frugal, slices
from lorebase.workers import ship

#: Fixed values of byte-level BPE: how a text is cut into words before merging (white space by its Unicode property).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts within Latin-1, spelled out for the faster matcher: letters, numbers, white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r" \t-\r\x85\xa0"
LATIN_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Words kept by a worker between batches; the table is emptied when full, which changes no result.
KEPT_WORDS = 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next from 256 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE vocabulary: merges as sorted pair keys, and the bytes of each id."""

    def __init__(self, spec: dict) -> None:
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_characters()
        of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([ids[c] for c in letters], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.bytes: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in ids.items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair at each place of ``at``; the number of merges where there is none."""
        out = np.full(len(at), len(self.ranks), np.int64)
        inner = np.flatnonzero(at < len(symbols) - 1)
        inner = inner[owner[at[inner]] == owner[at[inner] + 1]]
        if len(inner) and len(self.keys):
            pair = symbols[at[inner]] << 32 | symbols[at[inner] + 1]
            found = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[found] == pair
            out[inner[known]] = self.ranks[found[known]]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.

        All symbols stand in one flat array. A round looks up every neighbouring pair by binary search in the
        sorted keys, takes each word's lowest rank, and merges that pair wherever the word has it, from the
        left. Words without a known pair are done and leave the array.
        """
        done: list[list[int] | None] = [None] * len(words)
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        rank = self._ranks(symbols, owner, np.arange(len(symbols)))
        none = len(self.ranks)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            counts = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            over = lowest == none
            if over.any():
                ended = np.repeat(over, counts)
                ids, sizes = symbols[ended].tolist(), counts[over].tolist()
                at = 0
                for w, n in zip(owner[starts[over]].tolist(), sizes, strict=True):
                    done[w] = ids[at : at + n]
                    at += n
                left = ~ended
                symbols, owner, rank = symbols[left], owner[left], rank[left]
                lowest, counts = lowest[~over], counts[~over]
                if not len(symbols):
                    break
            here = rank == np.repeat(lowest, counts)
            chained = here & np.r_[False, here[:-1]]
            if chained.any():  # of a run of overlapping pairs only every other one
                place = np.arange(len(here))
                began = np.maximum.accumulate(np.where(here & ~chained, place, -1))
                here &= (place - began) % 2 == 0
            symbols[here] = self.merged[rank[here]]
            keep = np.r_[True, ~here[:-1]]
            symbols, owner, rank, new = symbols[keep], owner[keep], rank[keep], np.flatnonzero(here[keep])
            near = np.unique(np.r_[new, new - 1])  # only pairs with a new symbol have another rank now
            near = near[near >= 0]
            rank[near] = self._ranks(symbols, owner, near)
        return [x or [] for x in done]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class Encoder:
    """Cuts texts into words and special tokens and keeps what the words of earlier batches became.

    ``form`` says what is kept of a word: ids as text, their number and the decoded bytes ("digest"), the ids as 32-bit
    numbers ("ids"), or their number alone ("count").
    """

    def __init__(self, vocabulary: Vocabulary, form: str = "digest") -> None:
        self.v, self.words, self.form = vocabulary, regex.compile(WORDS), form
        self.latin = re.compile(LATIN_WORDS)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.kept: dict[str, tuple[str, int, bytes] | bytes | int] = {}

    def formed(self, ids: list[int]) -> tuple[str, int, bytes] | bytes | int:
        if self.form == "count":
            return len(ids)
        if self.form == "ids":
            return np.array(ids, np.int32).tobytes()
        return ",".join(map(str, ids)), len(ids), b"".join([self.v.bytes[i] for i in ids])

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            words = self.latin
        except UnicodeEncodeError:
            words = self.words
        if not any(s in text for s in self.v.special):
            return words.findall(text)
        return [w for part in self.special.split(text) if part for w in ([part] if part in self.v.special else words.findall(part))]

    def learn(self, cuts: list[list[str]]) -> None:
        """Encode the words that are new, shortest first in rounds of about 200,000 bytes."""
        if len(self.kept) > KEPT_WORDS:  # short words come again most
            short = {w: x for w, x in self.kept.items() if len(w) <= 9}
            self.kept = short if len(short) < KEPT_WORDS // 2 else {}
        new = sorted({w for c in cuts for w in c if w not in self.kept}, key=len)
        at = 0
        while at < len(new):
            batch, size = [], 0
            while at < len(new) and (not batch or size < 200_000):
                batch.append(new[at])
                size += len(new[at])
                at += 1
            plain = [w for w in batch if w not in self.v.special]
            for w in batch:
                if w in self.v.special:
                    self.kept[w] = self.formed([self.v.special[w]])
            for w, ids in zip(plain, self.v.encode_words([w.encode("utf-8", "surrogatepass") for w in plain]), strict=True):
                self.kept[w] = self.formed(ids)

    def encode(self, texts: list[str | None]) -> Iterator[list]:
        """For each text its words in the encoder's form."""
        at = 0
        while at < len(texts):
            cuts, size = [], 0
            while at < len(texts) and (not cuts or size < 2_000_000):
                cuts.append(self.cut(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            self.learn(cuts)
            kept = self.kept
            for c in cuts:
                yield [kept[w] for w in c]


_vocabularies: dict[str, Vocabulary] = {}


def _encoder(spec, form: str) -> Encoder:
    """A task's encoder; ``spec`` is the broadcast (key, description). The worker keeps the vocabulary for its next task."""
    key, text = spec.value
    if key not in _vocabularies:
        _vocabularies[key] = Vocabulary(json.loads(text))
    return Encoder(_vocabularies[key], form)


def _broadcast(spark: SparkSession, path: str | None):
    """The vocabulary file's text, a few MB whatever the corpus, so that workers need no file of their own."""
    ship(spark)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(text.encode()).hexdigest(), text))


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null texts count as empty (no ids). Equal rows give equal results; other columns are left out; an empty
    table gives no rows. Rows stream through in Arrow batches and nothing is shuffled.
    """
    spec = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec, "digest")
        for batch in slices(batches, 1):
            n, ids, decoded = [], [], []
            for words in encoder.encode(batch.column(1).to_pylist()):
                n.append(sum([w[1] for w in words]))
                ids.append(hashlib.sha256(",".join([w[0] for w in words]).encode()).hexdigest())
                data = b"".join([w[2] for w in words])
                decoded.append(hashlib.sha256(data.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(frugal(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every text; rules as in ``encode_digests``."""
    spec = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec, "ids")
        for batch in slices(batches, 1):
            ids = [b"".join(words) for words in encoder.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists], ["doc_id", "n_tokens", "ids"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(frugal(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of arrays of ids; null arrays give null. Unknown ids fail."""
    spec = _broadcast(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _encoder(spec, "count").v
        for batch in batches:
            texts = [None if x is None else v.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    slim = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """n_tokens of every text, one row each, without ids."""
    spec = _broadcast(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec, "count")
        for batch in slices(batches):
            n = [sum(words) for words in encoder.encode(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "n_tokens long")
