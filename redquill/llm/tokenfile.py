"""Token ids in files of independent zstandard frames.

A shard holds, in this order: frames, each the little-endian unsigned 32-bit
ids of some whole documents; a skippable frame with the index of the documents
(id, whether the id is there, frame, number of ids); a skippable frame with the
seek table (for each frame its compressed and plain size and the low half of
its XXH64), which ends in a footer of fixed size. A reader takes the footer,
the table and the index, and decompresses only frames that it needs; a frame
whose checksum differs raises ``ValueError``.

Shards follow the order of doc_id (null first; rows of one id by the beginning of
their text, then its hash; very many of one id fill several shards). Each
is written beside its final name and renamed, so a task that runs again leaves
one whole file.

Nulls: a null text is empty and gives its end id alone. An empty table gives no
rows. Repeated rows are written each. A document never spans frames, so a very
long one has a long frame. Other columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, small_batches, stored
from .tokens import chunks, encoder

# Fixed values of the published seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS, BEGIN = 65_536, 64
#: Bytes that a worker's memory of words takes at most while it writes shards.
WORD_BYTES = 96 << 20
_INDEX = np.dtype([("doc_id", "<i8"), ("there", "u1"), ("frame", "<u4"), ("n", "<u4")])
_ENTRY = struct.Struct("<qBII")  # as _INDEX
_SEEK = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


def _checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class ShardWriter:
    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        self.out, self.most = out, frame_ids * 4
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.size = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index, self.docs = bytearray(), 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index += _ENTRY.pack(doc_id or 0, doc_id is not None, len(self.seek), len(ids) // 4)
        self.docs += 1
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.seek.append((len(packed), len(raw), _checksum(raw)))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = bytes(self.index)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        seek = np.array(self.seek, _SEEK).tobytes()
        footer = struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(footer)) + seek + footer)


class ShardReader:
    """``source`` needs ``seek``, ``read`` and ``size`` as pyarrow's files have."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        frames, kind, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or kind != CHECKSUMS:
            raise ValueError("not a file of seekable frames")
        start = end - 9 - frames * _SEEK.itemsize
        self.seek = np.frombuffer(self._at(start, frames * _SEEK.itemsize), _SEEK)
        self.starts = np.concatenate([[0], np.cumsum(self.seek["packed"], dtype=np.int64)])
        magic, size = struct.unpack("<II", self._at(int(self.starts[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("the index of documents is missing")
        self.index = np.frombuffer(self._at(int(self.starts[-1]) + 8, size), _INDEX)
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, where: int, size: int) -> bytes:
        self.source.seek(where)
        return bytes(self.source.read(size))

    def frame(self, k: int) -> bytes:
        raw = self.unpacker.decompress(self._at(int(self.starts[k]), int(self.seek["packed"][k])), max_output_size=int(self.seek["plain"][k]))
        if len(raw) != self.seek["plain"][k] or _checksum(raw) != self.seek["sum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        now, raw, at = -1, b"", 0
        for doc_id, there, frame, n in self.index.tolist():
            if frame != now:
                now, raw, at = frame, self.frame(frame), 0
            yield (doc_id if there else None), raw[at : at + 4 * n]
            at += 4 * n

    def document(self, doc_id: int) -> bytes | None:
        """The ids of one document; only its frame is decompressed."""
        hit = np.flatnonzero((self.index["doc_id"] == doc_id) & (self.index["there"] == 1))
        if not len(hit):
            return None
        frame = self.index["frame"][hit[0]]
        before = self.index["n"][np.flatnonzero(self.index["frame"][: hit[0]] == frame)].sum(dtype=np.int64)
        return self.frame(int(frame))[4 * before : 4 * (before + int(self.index["n"][hit[0]]))]


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


def _written(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encode, end = encoder(path, WORD_BYTES), np.array([end_id], "<u4").tobytes()
        writer = fs = out = None
        target = f"{folder}/shard-{task.partitionId():07d}.ids.zst"
        ids = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            if names and writer is None:
                fs, place = _open(target)
                fs.create_dir(posixpath.dirname(place), recursive=True)
                draft = f"{place}.{task.taskAttemptId()}"
                out = fs.open_output_stream(draft)
                writer = ShardWriter(out)
            for a, b in chunks(texts):
                for name, raw in zip(names[a:b], encode.encode([t or "" for t in texts[a:b]])):
                    writer.add(name, raw + end)
                    ids += len(raw) // 4 + 1
        if writer is not None:
            writer.close()
            out.close()
            fs.move(draft, place)
            yield pa.record_batch([pa.array([task.partitionId()], pa.int64()), pa.array([target]), pa.array([writer.docs], pa.int64()), pa.array([ids], pa.int64())], names=["shard", "path", "docs", "ids"])

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 1, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes all documents in ascending order; returns the list of shards (shard, path, docs, ids), itself stored.

    There are ``shards`` files, or as many as the session has shuffle partitions (fewer where they are small).
    """
    small_batches(docs.sparkSession)
    folder = folder or new_path(docs.sparkSession, "token-files")
    order = ["doc_id", "_begin", "_h", "_number"]  # the number only splits rows that are alike
    keyed = docs.select("doc_id", "text", F.substring("text", 1, BEGIN).alias("_begin"), F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_number"))
    dealt = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions(*order).select("doc_id", "text")
    return stored(ordered.mapInArrow(_written(tokenizer_path, folder, end_id), "shard long, path string, docs long, ids long"), "token-shards")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, place = _open(path)
            with fs.open_input_file(place) as source:
                rows, start = [], base
                for doc_id, raw in ShardReader(source).documents():
                    rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
                    start += len(raw) // 4
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_files(shards: DataFrame) -> DataFrame:
    """A row for each document, from the files: doc_id, start, n_tokens, ids_crc32.

    The running total is over the list of shards, one row for each file.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    listed = shards.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).cast("long").alias("base"))
    return listed.repartition(partitions(shards.sparkSession), "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
