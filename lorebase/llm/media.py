"""Media columns: payloads stored as 8-bit images in archives, and a data source that reads them back.

An archive is a ZIP file of stored (not recompressed) PNG images; its directory lists every member's offset.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorebase.llm.common import frugal, new_path, slices
from lorebase.workers import ship

#: Samples in a row of an image; payloads are padded to a multiple of it.
WIDTH = 64
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes after which a writer starts another archive, and of a reader's batch.
ARCHIVE_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
#: Fixed part of a member's local header, before its name and extra field.
LOCAL_HEADER = 30


def _files(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and ":/" in uri:
        uri = uri.replace(":/", ":///", 1)
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


def pad(data: bytes) -> bytes:
    """``data`` with bytes 0 up to a positive multiple of 64."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def encode_png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, 64 to a row, that holds ``payload`` (a multiple of 64 bytes) losslessly."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row after its filter type, 0: none
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(lines, 2)) + chunk(b"IEND", b"")


def decode_png(image: bytes) -> np.ndarray:
    """The samples (rows, 64) of an image made by ``encode_png``; ValueError for anything else."""
    if image[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, height = 8, [], 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        data = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError(f"damaged {kind.decode('ascii', 'replace')} chunk")
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if width != WIDTH or form != [8, 0, 0, 0, 0]:
                raise ValueError("not an image of 8-bit grey samples in rows of 64")
        elif kind == b"IDAT":
            body.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Average hash of the 64 columns (a bit is set where a column's mean is above the image's), mean and deviation."""
    columns = samples.mean(axis=0)
    bits = np.packbits(columns > columns.mean()).tobytes().hex()
    return f"{bits}:{samples.mean():.4f}:{samples.std():.4f}"


def write_archives(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> int:
    """Store the texts of ``docs`` as images in archives under ``path``; returns the number of members.

    Each member's comment holds its id (empty if null) and the unpadded number of bytes. Null texts count as
    empty; repeated rows are members of their own; an empty table writes no archive. Archives end at 64 MB, texts stream
    through in batches. Every attempt of a task writes archives of its own, and what it wrote is its output: Spark
    commits the rows of one attempt to the folder's manifest, so archives of lost or repeated attempts are never read.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _files(path)
        fs.create_dir(root, recursive=True)
        attempt = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        archive, sink, written = None, None, []

        def finish() -> None:
            nonlocal archive
            members = len(archive.filelist)
            archive.close()
            written[-1] += (sink.tell(), members)
            sink.close()
            archive = None

        for batch in slices(batches, 1):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive is None:
                    written.append((f"{attempt}-{len(written):04d}.zip",))
                    sink = fs.open_output_stream(f"{root}/{written[-1][0]}")
                    archive = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED)
                data = (text or "").encode()
                info = zipfile.ZipInfo(f"{len(archive.filelist):010d}.png")
                info.comment = f"{'' if doc_id is None else doc_id},{len(data)}".encode()
                archive.writestr(info, encode_png(pad(data)))
                if sink.tell() >= ARCHIVE_BYTES:
                    finish()
        if archive is not None:
            finish()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "bytes", "members"), w, strict=True)) for w in written], _MANIFEST)

    spark = docs.sparkSession
    ship(spark)
    slim = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim.mapInArrow(frugal(write), "archive string, bytes long, members long").write.parquet(f"{path}/{MANIFEST}")
    return spark.read.schema("members long").parquet(f"{path}/{MANIFEST}").agg(F.sum("members")).first()[0] or 0


#: The folder beside the archives that lists those that count, with their bytes and members.
MANIFEST = "manifest"
_MANIFEST = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])


class ByteRange(InputPartition):
    """The members of one archive whose headers begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__((path, start, end))
        self.path, self.start, self.end = path, start, end


class Archive:
    """One open file for all members of a range, opened anew after a failure."""

    def __init__(self, fs: pa.fs.FileSystem, path: str) -> None:
        self.fs, self.path, self.opened = fs, path, None

    def file(self) -> pa.NativeFile:
        if self.opened is None:
            self.opened = self.fs.open_input_file(self.path)
        return self.opened

    def close(self) -> None:
        if self.opened is not None:
            self.opened.close()
        self.opened = None


class MediaReader(DataSourceReader):
    """Plans byte ranges from the archives' sizes in the manifest, or in the folder where there is none; a task reads its archive's directory itself."""

    def __init__(self, options: dict) -> None:
        self.root, self.range_bytes, self.attempts = options["path"], int(options.get("rangeBytes", 16 << 20)), 1 + int(options.get("retries", 3))

    def partitions(self) -> list[ByteRange]:
        fs, root = _files(self.root)
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.Directory:
            listed = pa.dataset.dataset(f"{root}/{MANIFEST}", _MANIFEST, "parquet", fs).to_table()
            files = sorted(zip((f"{root}/{x}" for x in listed["archive"].to_pylist()), listed["bytes"].to_pylist(), strict=True))
        else:
            found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
            files = sorted((x.path, x.size) for x in found if x.is_file and x.extension == "zip" and not x.base_name.startswith("."))
        return [ByteRange(p, a, min(a + self.range_bytes, n)) for p, n in files for a in range(0, n, self.range_bytes)] or [ByteRange("", 0, 0)]

    def _again(self, what, archive: Archive):
        """``what()``, tried again with the archive opened anew."""
        for left in reversed(range(self.attempts)):
            try:
                return what()
            except (OSError, ValueError, zlib.error, struct.error):
                archive.close()
                if not left:
                    raise
        return None

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        archive = Archive(_files(self.root)[0], partition.path)
        try:
            yield from self._members(partition, archive)
        finally:
            archive.close()

    def _members(self, partition: ByteRange, archive: Archive) -> Iterator[pa.RecordBatch]:
        def member(info: zipfile.ZipInfo) -> tuple[bytes, np.ndarray]:
            """Read at its own offset, so a failure touches no other member."""
            f = archive.file()
            head = f.read_at(LOCAL_HEADER, info.header_offset)
            name, extra = struct.unpack("<HH", head[26:30])
            image = f.read_at(info.file_size, info.header_offset + LOCAL_HEADER + name + extra)
            if zlib.crc32(image) != info.CRC:
                raise ValueError("damaged member")
            return image, decode_png(image)

        rows, held = [], 0
        for info in self._again(lambda: zipfile.ZipFile(archive.file()).infolist(), archive):
            if not partition.start <= info.header_offset < partition.end:
                continue
            row = {"archive": partition.path.rpartition("/")[2], "member": info.filename, "offset": info.header_offset, "note": info.comment.decode(), "media_bytes": info.file_size, "media_sha256": None, "payload": None, "feature": None, "error": None}
            try:
                image, samples = self._again(lambda info=info: member(info), archive)
                row |= {"media_sha256": hashlib.sha256(image).hexdigest(), "payload": samples.tobytes(), "feature": feature(samples)}
                held += len(row["payload"])
            except (OSError, ValueError, zlib.error, struct.error) as e:
                row["error"] = f"{type(e).__name__}: {e}"
            rows.append(row)
            if held >= BATCH_BYTES or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, SCHEMA)


SCHEMA = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("note", pa.string()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload", pa.binary()), ("feature", pa.string()), ("error", pa.string())])


class MediaSource(DataSource):
    """``spark.read.format("media_archive").option("rangeBytes", n).option("retries", n).load(folder)``.

    One row per member: archive, member, offset, note (its comment), media_bytes, media_sha256, payload,
    feature, error. A member that can't be read after all retries has its error and null values; the others
    are not touched. A folder without archives gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, member string, offset long, note string, media_bytes long, media_sha256 string, payload binary, feature string, error string"

    def reader(self, schema) -> MediaReader:  # noqa: ARG002
        return MediaReader(self.options)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").load(path)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts as media in the shared folder and describe what is read back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes,
    media_sha256, feature. Null and empty texts have a payload of 64 bytes 0; null ids stay null; an empty
    table gives no rows; other columns are left out. A member that stays unreadable fails the query.
    """
    spark = docs.sparkSession
    path = new_path(spark, "media")
    write_archives(docs, path, id_col, text_col)
    note = F.split("note", ",")
    payload = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("archive", F.lit(" "), "member", F.lit(": "), "error")).cast("binary")).otherwise(F.col("payload"))
    out = read_archives(spark, path).withColumn("payload", payload)
    return out.select(
        F.expr("try_cast(nullif(split(note, ',')[0], '') AS long)").alias("doc_id") if dict(docs.dtypes)[id_col] != "string" else F.nullif(note[0], F.lit("")).alias("doc_id"),
        note[1].cast("long").alias("n_bytes"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{WIDTH}, {WIDTH})")).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
    )
