"""Logs of length-prefixed frames in binary files, as DataFrames of records.

A frame is a length of 4 bytes, big-endian, and as many bytes: a batch of JSON lines, one raw JSON record, or one
compressed record, told apart by the first bytes. A frame that is cut off is an error and not skipped; `salvage` keeps
what comes before it and says where it stopped.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import oplog

# fixed values of the format
BATCH, RAW = 0xFF, 0x00
GZIP_MAGIC, ZSTD_MAGIC = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"
RAW_UP_TO = 96

RECORD = "path string, number long, offset long, json string, error string"


class TruncatedFrame(ValueError):
    pass


def unpacked(payload: bytes) -> list[bytes]:
    """The JSON records of one frame."""
    if payload[:1] == bytes([BATCH]):
        return [x for x in payload[1:].split(b"\n") if x.strip()]
    if payload[:1] == bytes([RAW]):
        return [payload[1:]]
    if payload.startswith(GZIP_MAGIC):
        return [gzip.decompress(payload)]
    if payload.startswith(ZSTD_MAGIC):
        import zstandard

        return [zstandard.ZstdDecompressor().decompressobj().decompress(payload)]
    raise ValueError("unknown kind of frame")


def frames(data: bytes):
    """(offset, records) of each frame; raises TruncatedFrame at one that is cut off."""
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise TruncatedFrame(f"the length at byte {at} is cut off")
        (n,) = struct.unpack_from(">I", data, at)
        if at + 4 + n > len(data):
            raise TruncatedFrame(f"the frame at byte {at} is cut off: {len(data) - at - 4} of {n} bytes")
        yield at, unpacked(data[at + 4 : at + 4 + n])
        at += 4 + n


def packed(records: list[dict], batch: bool = False, codec: str = "gzip") -> bytes:
    """Frames of the records: one batch, or one frame each, compressed where the record is longer than RAW_UP_TO bytes."""
    lines = [json.dumps(r, separators=(",", ":"), ensure_ascii=False).encode() for r in records]

    def small(line):
        if len(line) <= RAW_UP_TO:
            return bytes([RAW]) + line
        if codec == "zstd":
            import zstandard

            return zstandard.ZstdCompressor(level=1).compress(line)
        return gzip.compress(line, 6, mtime=0)

    payloads = [bytes([BATCH]) + b"\n".join(lines)] if batch else [small(x) for x in lines]
    return b"".join(struct.pack(">I", len(p)) + p for p in payloads)


def records_of(files: DataFrame, salvage: bool = False) -> DataFrame:
    """RECORD of (path, content): a row for each record, numbered within its file. A cut-off or damaged frame fails the
    job, or with `salvage` is a last row with the error."""

    def run(batches):
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                try:
                    for at, found in frames(data.as_py() or b""):
                        rows += [(path, len(rows) + i, at, x.decode(), None) for i, x in enumerate(found)]
                except (ValueError, EOFError, OSError, zlib.error) as e:
                    if not salvage:
                        raise
                    rows.append((path, len(rows), None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])], names=names)

    return files.select("path", "content").mapInArrow(run, RECORD)


def read_frames(spark: SparkSession, folder: str, salvage: bool = False) -> DataFrame:
    """Log rows of all files of a folder; the order of records is by the files' paths and places in them."""
    found = records_of(spark.read.format("binaryFile").load(folder), salvage)
    fields = F.from_json("json", ", ".join(f for f in oplog.SCHEMA.split(", ") if not f.startswith("lsn ")), {"mode": "PERMISSIVE" if salvage else "FAILFAST"})
    return found.select("path", "number", "error", fields.alias("r")).select("path", "number", "error", "r.*")
