"""WARC files and their fixity by Merkle trees.

A record is rendered in the published format (version line, named fields, payload,
two line ends) and is a gzip member of its own. Records lie in files ("shards") in
the order of their ids; offsets and lengths are those of the plain records. A leaf is
the SHA-256 of a whole record with its offset range; a node is the SHA-256 of up to
``FANOUT`` children in order with the range they span.

The audit compares the roots of two replicas, file by file, and descends only below
nodes that differ, down to the records. A record put in or left out shifts all that
follow, so records of differing branches are then aligned by their id and digest:
``moved`` (the same bytes at another offset), ``changed`` (another record of the same
id), ``missing`` (in the first alone) or ``extra`` (in the second alone); all other
records are ``ok``.

Nulls: a null url or page is empty; records of null ids lie in files of their own,
before all, by their digests. Repeated rows are records each, in the order of their
digests; records of one id share a file. Very long pages are one record. An empty
table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, small_batches, stored

FANOUT, SHARD_IDS = 16, 512
VERSION, DATE = "WARC/1.1", "2020-01-01T00:00:00Z"
GZIP = 31  # window bits of a gzip member
LEAF = "shard long, pos long, offset long, length long, digest string, page_id long"


def record(page_id: Column, url: Column, page: Column) -> Column:
    """The bytes of a ``resource`` record."""
    body = F.coalesce(page, F.lit("")).cast("binary")
    uri = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def _shard(pages: DataFrame, shard_ids: int) -> Column:
    """The file of a row with page_id and digest."""
    absent = -(-pages.where(F.col("page_id").isNull()).count() // shard_ids)
    return F.coalesce(F.floor(F.col("page_id") / shard_ids).cast("long"), F.pmod(F.xxhash64("digest"), F.lit(max(1, absent))) - F.lit(2**62))


def leaves(pages: DataFrame, shard_ids: int = SHARD_IDS) -> DataFrame:
    """shard, pos, offset, length, digest, page_id as files of these pages would have them; no page moves."""
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("_r")).select("page_id", F.octet_length("_r").cast("long").alias("length"), F.sha2("_r", 256).alias("digest")).withColumn("shard", _shard(pages, shard_ids))
    order = Window.partitionBy("shard").orderBy("page_id", "digest")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return rows.select("shard", (F.row_number().over(order) - 1).cast("long").alias("pos"), before.alias("offset"), "length", "digest", "page_id")


def tree(leaf: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels 0 (records) to ``height`` (roots), each stored: shard, pos, start, end, hash."""
    level = leaf.select("shard", "pos", F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), "digest").withColumn("hash", F.sha2(F.concat_ws("|", F.lit("leaf"), "start", "end", "digest"), 256)).drop("digest")
    levels = [level]
    for _ in range(height):
        children = F.array_sort(F.collect_list(F.struct("pos", "hash")))  # at most ``fanout``
        grouped = levels[-1].groupBy("shard", F.floor(F.col("pos") / fanout).cast("long").alias("pos")).agg(F.min("start").alias("start"), F.max("end").alias("end"), children.alias("_c"))
        levels.append(stored(grouped.select("shard", "pos", "start", "end", F.sha2(F.concat_ws("|", F.lit("node"), "start", "end", F.concat_ws("|", F.col("_c.hash"))), 256).alias("hash")), "warc-level"))
    return levels


def _suspects(first: DataFrame, second: DataFrame, fanout: int) -> DataFrame:
    """(shard, pos, hash, other): places of records in differing branches, by descent from the roots."""
    longest = first.select("pos").unionByName(second.select("pos")).agg(F.max("pos")).first()[0]
    height = 0
    while fanout**height <= (longest or 0):
        height += 1
    a, b = tree(first, height, fanout), tree(second, height, fanout)
    suspects = None
    for level in range(height, -1, -1):
        left, right = a[level].select("shard", "pos", "hash"), b[level].select("shard", "pos", F.col("hash").alias("other"))
        if suspects is not None:
            parents = suspects.select("shard", F.col("pos").alias("_p"))
            below = lambda df: df.withColumn("_p", F.floor(F.col("pos") / fanout).cast("long")).join(parents, ["shard", "_p"], "left_semi").drop("_p")
            left, right = below(left), below(right)
        suspects = stored(left.join(right, ["shard", "pos"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))), "warc-suspects")
    return suspects


def audit(first: DataFrame, second: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Every record of both replicas with its status. Takes two tables of leaves."""
    first, second = stored(first, "warc-a"), stored(second, "warc-b")
    suspects = _suspects(first, second, fanout)
    place = ["shard", "pos"]
    numbered = lambda df, *key: df.withColumn("_k", F.row_number().over(Window.partitionBy("shard", "page_id", *key).orderBy("pos")))
    own = lambda df, side: df.join(suspects.where(F.col(side).isNotNull()).select(*place), place, "left_semi")

    def aligned(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
        """Rows (pos, other) of one shard, id and ``key``, the first with the first and so on; null where there is none."""
        a = numbered(left, *key).select("shard", "pos", "page_id", "_k", *key)
        b = numbered(right, *key).select(F.col("shard").alias("_s"), F.col("pos").alias("_pos"), F.col("page_id").alias("_id"), F.col("_k").alias("_n"), *[F.col(c).alias(f"_o_{c}") for c in key])
        same = (F.col("shard") == F.col("_s")) & F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("_k") == F.col("_n"))
        for c in key:
            same = same & (F.col(c) == F.col(f"_o_{c}"))
        return stored(a.join(b, same, "full").select(F.coalesce("shard", "_s").alias("shard"), "pos", F.col("_pos").alias("other")), "warc-aligned")

    left, right = stored(own(first, "hash"), "warc-left"), stored(own(second, "other"), "warc-right")
    moved = aligned(left, right, "digest")
    lone = lambda df, pairs, a, b: df.join(pairs.where(F.col(a).isNotNull() & F.col(b).isNull()).select("shard", F.col(a).alias("pos")), place, "left_semi")
    rest = aligned(lone(left, moved, "pos", "other"), lone(right, moved, "other", "pos"))
    both = F.col("pos").isNotNull() & F.col("other").isNotNull()
    found = moved.where(both).select(*place, F.lit("moved").alias("_s")).unionByName(rest.where(both).select(*place, F.lit("changed").alias("_s")))
    found = found.unionByName(rest.where("other is null").select(*place, F.lit("missing").alias("_s")))
    kept = first.join(found, place, "left").withColumn("status", F.coalesce("_s", F.lit("ok"))).drop("_s")
    extra = second.join(rest.where("pos is null").select("shard", F.col("other").alias("pos")), place, "left_semi").withColumn("status", F.lit("extra"))
    return kept.unionByName(extra)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records as gzip members, so that they move compressed."""
    for batch in batches:
        raws = batch.column(2).to_pylist()
        packed = []
        for raw in raws:
            packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            packed.append(packer.compress(raw) + packer.flush())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["page_id", "digest", "member"])


class _Files:
    """Writes files one after the other, each beside its final name until it is whole."""

    def __init__(self, folder: str):
        from pyspark import TaskContext

        self.folder, self.attempt = folder, TaskContext.get().taskAttemptId()
        self.fs, self.base = pafs.FileSystem.from_uri(folder)
        self.now = self.out = None
        self.done: list[list] = []

    def write(self, shard: int, member: bytes) -> None:
        if shard != self.now:
            self.close()
            self.fs.create_dir(self.base, recursive=True)
            self.now, self.out = shard, self.fs.open_output_stream(f"{self._name(shard)}.{self.attempt}", compression=None)
            self.done.append([shard, f"{self.folder}/part-{shard}.warc.gz", 0])
        self.out.write(member)
        self.done[-1][2] += 1

    def _name(self, shard: int) -> str:
        return posixpath.join(self.base, f"part-{shard}.warc.gz")

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(f"{self._name(self.now)}.{self.attempt}", self._name(self.now))
            self.out = None

    def listed(self) -> pa.RecordBatch:
        self.close()
        shard, path, n = zip(*self.done) if self.done else ((), (), ())
        return pa.record_batch([pa.array(shard, pa.int64()), pa.array(path, pa.string()), pa.array(n, pa.int64())], names=["shard", "path", "records"])


def write_warc(pages: DataFrame, folder: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the records to files by shard, in order; returns stored rows (shard, path, records)."""
    small_batches(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = pages.select("page_id", record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).select("page_id", F.sha2("r", 256).alias("digest"), "r")
    packed = rows.mapInArrow(_members, "page_id long, digest string, member binary").withColumn("shard", _shard(pages, shard_ids))
    ordered = packed.repartition(partitions(pages.sparkSession), "shard").sortWithinPartitions("shard", "page_id", "digest").select("shard", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder)
        for batch in batches:
            for shard, member in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files.write(shard, member)
        yield files.listed()

    return stored(ordered.mapInArrow(run, "shard long, path string, records long"), "warc-files")


# Fields of a record's head.
_LENGTH = re.compile(rb"^Content-Length: *(\d+)\r$", re.M | re.I)
_URI = re.compile(rb"^WARC-Target-URI: *(.*?)\r$", re.M | re.I)
_PAGE = re.compile(rb"^WARC-Record-ID: *<urn:page:(-?\d*)>\r$", re.M | re.I)


def _split(raw: bytes, at: int) -> tuple[bytes, bytes]:
    """Head and payload of a plain record."""
    end = raw.find(b"\r\n\r\n") + 4
    size = _LENGTH.search(raw[:end])
    if end < 4 or not size or len(raw) != end + int(size[1]) + 4:
        raise ValueError(f"the record at {at} is not whole")
    return raw[:end], raw[end:-4]


def read_members(source, size: int = 1 << 20) -> Iterator[tuple[bytes, bytes]]:
    """Each gzip member of a file and what it holds, one at a time."""
    rest = b""
    while rest or (rest := source.read(size)):
        unpack, packed, plain = zlib.decompressobj(GZIP), [], []
        while not unpack.eof:
            if not rest and not (rest := source.read(size)):
                raise ValueError("the last record is not whole")
            try:
                plain.append(unpack.decompress(rest))
            except zlib.error as e:
                raise ValueError("a record is not whole") from e
            used = len(rest) - len(unpack.unused_data)
            packed.append(rest[:used])
            rest = unpack.unused_data
        yield b"".join(packed), b"".join(plain)


def read_warc(files: DataFrame, pages: bool = False) -> DataFrame:
    """Leaves read back from files (shard, path); with ``pages`` also url and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, path in ((s, p) for b in batches for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            fs, place = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(place, compression=None) as source:
                rows, at, held = [], 0, 0
                for pos, (_, raw) in enumerate(read_members(source)):
                    head, body = _split(raw, at)
                    page, uri = _PAGE.search(head), _URI.search(head)
                    row = (shard, pos, at, len(raw), hashlib.sha256(raw).hexdigest(), int(page[1]) if page and page[1] else None)
                    rows.append((*row, uri[1].decode("utf-8", "replace") if uri else "", body.decode("utf-8", "replace")) if pages else row)
                    at, held = at + len(raw), held + len(raw)
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)

    schema = f"{LEAF}, url string, html string" if pages else LEAF
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64() if c.split()[1] == "long" else pa.string() for c in schema.split(", ")]
    made = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
    return files.select("shard", "path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, schema)


def copy_warc(files: DataFrame, folder: str | None = None, change: Callable[[int | None, bytes], bytes | None] | None = None) -> DataFrame:
    """Copies files, member by member, to another folder; returns stored rows (shard, path, records).

    ``change`` gives for an id and payload what the copy has as payload instead (of the
    same length or not; the head stays as it is but for its length), or None to leave the record out.
    """
    folder = folder or new_path(files.sparkSession, "warc-copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Files(folder)
        for shard, path in ((s, p) for b in batches for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            fs, place = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(place, compression=None) as source:
                for member, raw in read_members(source):
                    if change is not None:
                        head, body = _split(raw, 0)
                        page = _PAGE.search(head)
                        new = change(int(page[1]) if page and page[1] else None, body)
                        if new is None:
                            continue
                        if new != body:
                            packer = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                            head = _LENGTH.sub(b"Content-Length: %d\r" % len(new), head)
                            member = packer.compress(head + new + b"\r\n\r\n") + packer.flush()
                    out.write(shard, member)
        yield out.listed()

    return stored(files.select("shard", "path").repartition(partitions(files.sparkSession), "path").mapInArrow(run, "shard long, path string, records long"), "warc-files")


def fixity(spark: SparkSession, pages: DataFrame, replica: DataFrame) -> DataFrame:
    """The audit of the files that two tables of pages make."""
    return audit(read_warc(write_warc(pages)), read_warc(write_warc(replica)))
