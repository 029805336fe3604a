"""Token ids in shard files of bit-plane shuffled, compressed blocks.

A shard holds documents in ascending order of their ids. Their token ids form one stream, cut into
blocks of a fixed number of ids. A block of 32-bit ids is transposed into planes: the plane of byte
``k`` holds byte ``k`` of every id (or, for ``bits``, one bit of every id), and each plane is
compressed on its own. A planned layout:

    planes of block 0 | planes of block 1 | ... | index | length of the index, 8 bytes | magic, 8 bytes

The index is a compressed JSON head (ids per block, sizes of each plane, the block's ids) and the ids
and lengths of the documents. Reading a range of ids needs the index and the blocks that hold it.

Spark deals rows out by ranges of the document id and sorts each range, so one task writes one shard
and holds one block, whatever the lengths of texts. Names of shards come from the committed manifest
only. Defined results: a null text is an empty text; an empty text has the end id alone; null ids come
first; repeated ids follow one another in the order of their texts; an empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import byte_ids
from corpusloom.llm.files import new_name, open_folder, shared_folder
from corpusloom.session import materialize

MAGIC = b"BITPLAN1"
MANIFEST = "path string, first_id long, docs long, ids long"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of a block of uint32 ids, lowest byte (or bit) first."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range(4)]
    flags = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(flags[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int) -> np.ndarray:
    if len(planes) == 4:
        as_bytes = np.empty((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            as_bytes[:, k] = np.frombuffer(plane, np.uint8)
    else:
        flags = np.empty((count, 32), np.uint8)
        for k, plane in enumerate(planes):
            flags[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
        as_bytes = np.packbits(flags, axis=1, bitorder="little")
    return as_bytes.reshape(-1).view("<u4")


class ShardWriter:
    """Documents in, one shard file out; holds one block of ids and the documents' ids and lengths."""

    def __init__(self, sink, block: int, bits: bool, level: int) -> None:
        self.sink, self.block, self.bits = sink, block, bits
        self.press = zstandard.ZstdCompressor(level=level)
        self.pending = bytearray()
        self.planes: list[list[int]] = []
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending += ids
        whole = len(self.pending) // (4 * self.block) * 4 * self.block
        for at in range(0, whole, 4 * self.block):
            self._write(bytes(self.pending[at : at + 4 * self.block]))
        del self.pending[:whole]

    def _write(self, block: bytes) -> None:
        packed = [self.press.compress(p) for p in to_planes(np.frombuffer(block, "<u4"), self.bits)]
        for p in packed:
            self.sink.write(p)
        self.planes.append([len(p) for p in packed])

    def close(self) -> None:
        rest = len(self.pending) // 4
        if rest:
            self._write(bytes(self.pending))
        head = {"block": self.block, "last": rest, "planes": self.planes, "docs": len(self.lengths)}
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        index = b"".join(
            [
                json.dumps(head).encode() + b"\n",
                known.tobytes(),
                np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
                np.array(self.lengths, "<i8").tobytes(),
            ]
        )
        packed = self.press.compress(index)
        self.sink.write(packed + struct.pack("<Q", len(packed)) + MAGIC)
        self.sink.close()


class ShardReader:
    """A shard's index, and its documents in pieces of at most one block."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a shard file")
        (length,) = struct.unpack("<Q", tail[:8])
        index = zstandard.ZstdDecompressor().decompress(source.read_at(length, size - 16 - length))
        cut = index.index(b"\n") + 1
        self.head = json.loads(index[:cut])
        n = self.head["docs"]
        known = np.frombuffer(index, np.uint8, n, cut)
        ids = np.frombuffer(index, "<i8", n, cut + n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.lengths = np.frombuffer(index, "<i8", n, cut + 9 * n)

    def blocks(self) -> Iterator[bytes]:
        at, expand = 0, zstandard.ZstdDecompressor()
        planes = self.head["planes"]
        for i, sizes in enumerate(planes):
            raw = self.source.read_at(sum(sizes), at)
            at += sum(sizes)
            count = self.head["last"] if self.head["last"] and i == len(planes) - 1 else self.head["block"]
            parts, cut = [], 0
            for s in sizes:
                parts.append(expand.decompress(raw[cut : cut + s]))
                cut += s
            yield from_planes(parts, count).tobytes()

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        """(document id, number of ids, CRC-32 of the ids) of every document."""
        blocks, held, at = self.blocks(), b"", 0
        for doc_id, length in zip(self.doc_ids, self.lengths):
            need, crc = int(length) * 4, 0
            while need:
                if at == len(held):
                    held, at = next(blocks), 0
                piece = memoryview(held)[at : at + need]
                crc = zlib.crc32(piece, crc)
                at += len(piece)
                need -= len(piece)
            yield doc_id, int(length), crc


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int | None = None,
    block: int = 65_536,
    bits: bool = False,
    level: int = 1,
) -> DataFrame:
    """Encode every text, append ``end_id``, write shards; the manifest has one row per shard.

    ``shards`` is the number of ranges, by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "shards")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = byte_ids.encoder(tokenizer)
        fs, place = open_folder(folder)
        writer, path, first, total = None, "", None, 0
        for pdf in batches:
            for doc_id, ids in zip(pdf["id"], encode(pdf["text"].tolist())):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if writer is None:
                    fs.create_dir(place, recursive=True)
                    path, first = new_name(place, ".ids"), doc_id
                    writer = ShardWriter(fs.open_output_stream(path), block, bits, level)
                writer.add(doc_id, ids + end)
                total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            out = pd.DataFrame({"path": [path], "first_id": [first], "docs": [len(writer.lengths)], "ids": [total]})
            yield out.astype({"first_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(shards, "id").sortWithinPartitions("id", "text")
    manifest = materialize(dealt.mapInPandas(write, MANIFEST))
    return manifest.withColumn("folder", F.lit(folder))


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of ``manifest``.

    The offset of a shard is a running sum over one row per shard.
    """
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for folder, path, start in zip(pdf["folder"], pdf["path"], pdf["start"]):
                fs, _ = open_folder(folder)
                with fs.open_input_file(path) as source:
                    rows, at = [], int(start)
                    for doc_id, length, crc in ShardReader(source).documents():
                        rows.append((doc_id, at, length, crc))
                        at += length
                    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                    yield out.astype({"doc_id": "Int64"})

    placed = manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    shards = max(1, manifest.count())
    return placed.repartition(shards).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
