"""Document packages: ZIP archives of named parts, read and written on the executors.

A scan gives a row for each part, or one row with an error for a file that is no
such package; nothing is dropped in silence. The writer is deterministic: parts
keep their order, carry one fixed time, and are deflated only where that is
shorter, so equal parts give equal bytes. One package at a time is in memory.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = "seq int, part_name string, payload binary, error string"
#: The most bytes that a single part may inflate to; a longer part is an error, not a crash.
PART_LIMIT = 1 << 28
#: Fixed value: the time in every entry (dos date 0x5c21).
_WHEN = (2026, 1, 1, 0, 0, 0)


def unpack(data: bytes, part_limit: int = PART_LIMIT) -> list[tuple[str, bytes]]:
    """Parts in directory order; ValueError for what is not a plain package."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            out: dict[str, bytes] = {}
            for info in z.infolist():
                if info.flag_bits & 1:
                    raise ValueError("ENCRYPTED_ENTRY")
                if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError("UNSUPPORTED_METHOD")
                if info.extract_version >= 45:
                    raise ValueError("ZIP64_UNSUPPORTED")
                if info.file_size > part_limit:
                    raise ValueError("PART_TOO_LARGE")
                out[info.filename] = z.read(info)
            return list(out.items())
    except ValueError:
        raise
    except Exception as e:  # a damaged archive fails in many ways: bad directory, checksum, stream
        raise ValueError("INVALID_PACKAGE") from e


def pack(parts: Iterable[tuple[str, bytes]]) -> bytes:
    """The archive of some parts, byte for byte the same on every run."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts:
            info = zipfile.ZipInfo(name, _WHEN)
            info.create_system = info.external_attr = 0
            z.writestr(info, data, zipfile.ZIP_DEFLATED, 9)
            if z.getinfo(name).compress_size >= len(data):
                # Rewind over an entry that deflating made no shorter.
                z.filelist.remove(z.getinfo(name))
                del z.NameToInfo[name]
                z.fp.seek(info.header_offset)
                z.fp.truncate()
                z.start_dir = info.header_offset
                plain = zipfile.ZipInfo(name, _WHEN)
                plain.create_system = plain.external_attr = 0
                z.writestr(plain, data, zipfile.ZIP_STORED)
    return out.getvalue()


def parts_of(packages: DataFrame, keys: str, content: str = "content", part_limit: int = PART_LIMIT) -> DataFrame:
    """A row for each part of a column of archives; ``keys`` is the DDL of the columns kept."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for *key, data in batch[[*names, content]].itertuples(index=False, name=None):
                try:
                    rows = [(i, name, payload, None) for i, (name, payload) in enumerate(unpack(bytes(data or b""), part_limit))]
                except ValueError as e:
                    rows = [(None, None, None, str(e))]
                yield pd.DataFrame([(*key, *row) for row in rows], columns=[*names, "seq", "part_name", "payload", "error"])

    return packages.select(*names, content).mapInPandas(run, f"{keys}, {PARTS}")


def scan(spark: SparkSession, path: str, part_limit: int = PART_LIMIT) -> DataFrame:
    """(path, seq, part_name, payload, error) of every package under a path or glob."""
    files = spark.read.format("binaryFile").load(path)
    return parts_of(files, "path string", part_limit=part_limit)


def gathered(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts): part rows (key, seq, part_name, payload) as one ordered array for each key."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "part_name", "payload")))
    return parts.groupBy(key).agg(F.transform(listed, lambda p: F.struct(p["part_name"].alias("part_name"), p["payload"].alias("payload"))).alias("parts"))


def packages_of(documents: DataFrame, keys: str, parts: str = "parts") -> DataFrame:
    """(keys, content): each row's array of (part_name, payload) as one archive, where the row lies."""
    names = [k.split()[0] for k in keys.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                content = pack((p["part_name"], p["payload"] or b"") for p in one.column(len(names))[0].as_py() or ())
                yield pa.record_batch([*one.columns[: len(names)], pa.array([content], pa.binary())], names=[*names, "content"])

    return documents.select(*names, parts).mapInArrow(run, f"{keys}, content binary")


def entry_name(name: Column) -> Column:
    """Slashes one way, none in front, none twice, no leading ./"""
    forward = F.regexp_replace(F.regexp_replace(name, r"\\", "/"), "^/+", "")
    return F.regexp_replace(F.regexp_replace(forward, r"^(\./)+", ""), "/+", "/")


def _framed(value: Column) -> Column:
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0")), value)


def revision_tokens(parts: DataFrame, key: str = "doc_id", scope: str = "package", magic: bytes = b"package-revision-token\x00") -> DataFrame:
    """(key, token, parts): SHA-256 over the length-framed parts in the order of their names.

    Systems that must agree on tokens pass the same ``magic``. A package with two
    parts of one normalised name has a null token.
    """
    entry = F.struct(F.encode(entry_name(F.col("part_name")), "UTF-16BE").alias("o"), _framed(F.encode(entry_name(F.col("part_name")), "UTF-8")).alias("n"), _framed(F.coalesce("payload", F.lit(b""))).alias("p"))
    listed = parts.where("part_name IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(F.lit(magic), number(F.lit(1)), _framed(F.lit(scope.encode())), number(F.size("_e")))
    body = F.aggregate("_e", F.lit(b""), lambda a, e: F.concat(a, e["n"], e["p"]))
    alone = F.size("_e") == F.size(F.array_distinct(F.transform("_e", lambda e: e["o"])))
    return listed.select(key, F.when(alone, F.sha2(F.concat(head, body), 256)).alias("token"), F.size("_e").alias("parts"))
