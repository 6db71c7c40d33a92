"""Token ids in sorted-string-table shards.

Documents are dealt out by ranges of their id and sorted; each task writes one shard. A shard is a file of

    blocks   entries in order of key, each: shared key bytes, own key bytes (one byte each), value length (4 bytes),
             the key's own bytes, the value; the first entry of a block shares nothing
    index    for each block: its first key (9 bytes), offset and length (8 bytes each)
    filter   a Bloom filter over the keys, FILTER_BITS bits a key, FILTER_HASHES hashes
    footer   FOOTER: offsets and lengths of index and filter, entries, ids, bytes an id, magic

A key is 9 bytes whose order is that of the ids: 0 for null, else 1 and the id with its sign bit flipped, big-endian. A
value is a document's ids, little-endian, two bytes each where the vocabulary allows it, else four. A lookup asks the
filter, then finds the block by binary search over the index.

A shard is written under a task's own name and renamed when whole, so a task that is run again leaves one whole shard.
Files go to the shared folder through its file system. Nothing but each shard's name and counts reaches the driver.

Defined results: null or empty text has the end id alone; rows that share an id are entries that follow each other, in
order of their texts; null ids come first; an empty table has no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 16
FILTER_BITS, FILTER_HASHES = 10, 7
ENTRY, INDEX, FOOTER = struct.Struct("<BBI"), struct.Struct("<9sQQ"), struct.Struct("<QQQQQQI4s")
MAGIC = b"FWS1"


def key_bytes(key: int | None) -> bytes:
    return b"\0" * 9 if key is None else b"\1" + (key + (1 << 63)).to_bytes(8, "big")


def key_of(raw: bytes) -> int | None:
    return int.from_bytes(raw[1:], "big") - (1 << 63) if raw[0] else None


def file_of(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def filter_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1
    return [(a + k * b) % bits for k in range(FILTER_HASHES)]


class ShardWriter:
    """Takes entries in order of key."""

    def __init__(self, sink, id_bytes: int):
        self.sink, self.id_bytes, self.at = sink, id_bytes, 0
        self.block, self.last, self.index = bytearray(), b"", []
        self.hashes: list[bytes] = []
        self.entries = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.index.append((key, self.at))
        self.block += ENTRY.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(key)
        self.entries += 1
        self.ids += len(value) // self.id_bytes

    def _close_block(self) -> None:
        self.sink.write(bytes(self.block))
        key, at = self.index[-1]
        self.index[-1] = (key, at, len(self.block))
        self.at += len(self.block)
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._close_block()
        index = b"".join(INDEX.pack(*x) for x in self.index)
        bits = max(FILTER_BITS * len(self.hashes), 64)
        marks = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.hashes:
            for place in filter_places(key, bits):
                marks[place >> 3] |= 1 << (place & 7)
        self.sink.write(index)
        self.sink.write(marks.tobytes())
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), bits, self.entries, self.ids, self.id_bytes, MAGIC))


class ShardReader:
    """One shard: all entries in order, or the entries of a key."""

    def __init__(self, uri: str):
        system, path = file_of(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        *places, self.entries, self.ids, self.id_bytes, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        at, length, self.filter_at, self.filter_bits = places
        self.blocks = list(INDEX.iter_unpack(self._read(at, length)))
        self.first_keys = [b[0] for b in self.blocks]

    def _read(self, at: int, length: int) -> bytes:
        return self.file.read_at(length, at)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        raw, at, key = self._read(block[1], block[2]), 0, b""
        while at < len(raw):
            shared, own, n = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in self.blocks:
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        return all(self._read(self.filter_at + (p >> 3), 1)[0] >> (p & 7) & 1 for p in filter_places(key, self.filter_bits))

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key."""
        raw, found = key_bytes(key), []
        if not self.may_hold(raw):
            return found
        at = max(bisect_right(self.first_keys, raw) - 1, 0)
        while at > 0 and self.first_keys[at] == raw:  # equal keys may begin in the block before
            at -= 1
        for block in self.blocks[at:]:
            if block[0] > raw:
                break
            found += [np.frombuffer(v, f"<u{self.id_bytes}") for k, v in self._entries(block) if k == raw]
        return found


def write_shards(docs: DataFrame, folder: str, encode: Callable[[], Callable[[pa.Array], list[bytes]]], key: str = "doc_id", text: str = "text", id_bytes: int = 2) -> DataFrame:
    """Write the shards; one row for each, in order of key: shard, path, entries, ids, and ids_before (in earlier shards).

    `encode()` is called in each task and returns a function from an array of texts to ids as little-endian 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, writer = TaskContext.get(), None
        name = f"{folder}/shard-{context.partitionId():06d}"
        for batch in batches:
            if batch.num_rows and writer is None:
                ids_of = encode()
                system, path = file_of(name)
                draft = f"{path}.{context.taskAttemptId()}-{uuid.uuid4().hex}"
                system.create_dir(path.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(draft)
                writer = ShardWriter(sink, id_bytes)
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                for k, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1)), strict=True):
                    writer.add(key_bytes(k), np.frombuffer(ids, "<u4").astype(f"<u{id_bytes}").tobytes())
        if writer is not None:
            writer.close()
            sink.close()
            system.move(draft, path)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "path": [name], "entries": [writer.entries], "ids": [writer.ids]})

    ordered = docs.select(key, text).repartitionByRange(key).sortWithinPartitions(key, text)
    written = sorted(ordered.mapInArrow(run, "shard int, path string, entries long, ids long").collect())  # a row for each shard
    rows, before = [], 0
    for r in written:
        rows.append((r["shard"], r["path"], r["entries"], r["ids"], before))
        before += r["ids"]
    return docs.sparkSession.createDataFrame(rows, "shard int, path string, entries long, ids long, ids_before long")


def read_shards(shards: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """One row for each document, read from the files: doc_id, start (ids of all documents before it), ids (little-endian 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = ShardReader(path)
                keys, starts, values, held = [], [], [], 0
                for raw, value in reader:
                    keys.append(key_of(raw))
                    starts.append(start)
                    values.append(np.frombuffer(value, f"<u{reader.id_bytes}").astype("<u4").tobytes())
                    start += len(value) // reader.id_bytes
                    held += len(values[-1])
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])
                        keys, starts, values, held = [], [], [], 0
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "ids"])

    n = max(shards.count(), 1)
    return shards.select("path", "ids_before", "shard").repartitionByRange(n, F.col("shard")).mapInArrow(run, "doc_id long, start long, ids binary")
