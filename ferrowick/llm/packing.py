"""Cost-balanced packing of token ids into sequences.

The cost of a piece is linear in its length, plus quadratic for its attention. Documents are packed in windows of
`window_sequences` sequences' worth of tokens. In a window, whole sequences are cut off long documents first; what is
left goes, by descending length, to the lowest-cost sequence with room for it, or, where none has room, is cut to
fill the lowest-cost sequence with any room. A window's sequences have capacity for its tokens exactly: as many full
ones as go in, and the rest as powers of two, so none is padded.

Each partition of the input is packed on its own, so nothing is dealt out and a lost task is packed again in the same
way; sequence ids hold the partition's number in their upper bits. A window holds its documents' ids only, and a
document longer than a window is a window of its own.

Defined results: null or empty text has the end id alone; ties keep the input's order; repeated rows are packed each;
an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrowtext import tidy

PARTITION_BITS = 40


@dataclass(frozen=True)
class Cost:
    """Of a piece of n tokens: linear * n + quadratic * n * n. The default weighs both alike at 2,048 tokens."""

    linear: float = 1.0
    quadratic: float = 1 / 2048

    def __call__(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n


def capacities(total: int, size: int) -> list[int]:
    """Full sequences, then powers of two that sum to the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def pack(lengths: list[int], size: int, cost: Cost) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; pieces fill the sequences of `capacities`."""
    room = capacities(sum(lengths), size)
    pieces: list[tuple[int, int, int, int, int]] = []
    used, costs = [0] * len(room), [0.0] * len(room)

    def put(doc: int, start: int, n: int, sequence: int) -> None:
        pieces.append((doc, start, n, sequence, used[sequence]))
        used[sequence] += n
        room[sequence] -= n
        costs[sequence] += cost(n)

    full, left = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            put(doc, start, size, full)
            full += 1
        if n % size:
            left.append((n % size, doc))
    open_ = [(costs[k], k) for k in range(full, len(room))]
    heapq.heapify(open_)
    for n, doc in sorted(left, key=lambda x: (-x[0], x[1])):
        start = lengths[doc] - n
        while n:
            passed = []
            while open_ and room[open_[0][1]] < n:
                passed.append(heapq.heappop(open_))
            sequence = heapq.heappop(open_)[1] if open_ else None
            if sequence is None:  # no sequence has room for all of it
                passed.sort()
                sequence = passed.pop(0)[1]
            for x in passed:
                heapq.heappush(open_, x)
            take = min(n, room[sequence])
            put(doc, start, take, sequence)
            start, n = start + take, n - take
            if room[sequence]:
                heapq.heappush(open_, (costs[sequence], sequence))
    return pieces


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[pa.Array], list[bytes]]], key: str = "doc_id", text: str = "text", size: int = 2048, window_sequences: int = 512, cost: Cost = Cost()) -> DataFrame:
    """One row for each piece: key, start, length, ids (little-endian 32 bits), doc_tokens, sequence_id, offset.

    `encode()` is called in each task and returns a function from an array of texts to ids.
    """
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL("start long, length long, ids binary, doc_tokens long, sequence_id long, offset long").fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, first = encode(), TaskContext.get().partitionId() << PARTITION_BITS
        keys: list = []
        held: list[bytes] = []
        tokens = 0

        def emptied() -> pa.RecordBatch:
            nonlocal first, keys, held, tokens
            lengths = [len(x) // 4 for x in held]
            pieces = pack(lengths, size, cost)
            columns = [
                [keys[d] for d, *_ in pieces], [s for _, s, *_ in pieces], [n for _, _, n, *_ in pieces], [held[d][4 * s : 4 * (s + n)] for d, s, n, *_ in pieces],
                [lengths[d] for d, *_ in pieces], [first + q for *_, q, _ in pieces], [o for *_, o in pieces],
            ]
            first += len(capacities(sum(lengths), size))
            keys, held, tokens = [], [], 0
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            key_type = batch.column(0).type
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                for k, ids in zip(part.column(0).to_pylist(), ids_of(part.column(1)), strict=True):
                    if held and tokens + len(ids) // 4 > size * window_sequences:
                        yield emptied()
                    keys.append(k)
                    held.append(ids)
                    tokens += len(ids) // 4
        if held:
            yield emptied()

    return docs.select(key, text).mapInArrow(tidy(run), schema)
