"""Byte-level BPE with DuckDB: encoding by a recursive query, decoding by an ordered aggregation.

Each task splits its texts by the vocabulary's pattern into pieces and encodes each distinct piece once. A piece that
is a token is that token. All others start as their bytes' tokens and the ranks of their neighbouring pairs; in
each round of a recursive query each piece contracts its leftmost pair of minimum rank, the two pairs that this makes join
the merge table, and pieces without a pair are done. The recursion keeps one state for each piece. A piece of over LONG_BYTES is cut into
segments, which are encoded together and then joined two by two: the tokens about a joint are encoded anew, and where the first and
the last of them come out as they were, so does all beyond them, as a sequence is the encoding of its text just if each
two neighbours are that of theirs. Else more tokens are taken. Decoding joins ids with the vocabulary and
concatenates the bytes in order.

Defined results: null counts as empty, which has no ids; ids outside the vocabulary are an error in decoding; strings of
special tokens are ordinary text; repeated rows are encoded each; an empty table gives no rows. Texts are encoded whole, a
few megabytes at a time; a longer one alone. A worker keeps at most PIECES_KEPT pieces
that were met last, and those of the PIECES_KEPT before.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrowtext import with_arrays

PIECES_KEPT = 250_000
#: The rank of a pair that is no token, as in ENCODE; ranks are below it.
NO_PAIR = 65_536
SLICE_CHARS = 2_000_000
#: Bytes of a piece that is encoded in one go, bytes of a segment of a longer one, and the tokens taken first on each side of a joint.
LONG_BYTES, SEGMENT_BYTES, NEAR = 256, 64, 8
#: Pieces and tokens of one DuckDB query.
QUERY_PIECES, QUERY_IDS = 100_000, 1_000_000

# A token is (rank of the pair that it begins) << 46 | (its first byte) << 16 | id, so the least one begins the pair to contract.
ENCODE = """
WITH RECURSIVE state(piece, tokens) USING KEY (piece) AS (
  SELECT piece, tokens FROM pieces
  UNION
  SELECT piece, tokens[:greatest(p - 2, 0)]
      || CASE WHEN p > 1 THEN [(coalesce(l.merged, 65536)::BIGINT << 46) | (before & 70368744177663), fresh] ELSE [fresh] END
      || tokens[p + 2:]
  FROM (
    SELECT s.*, tokens[p - 1] AS before, (coalesce(r.merged, 65536)::BIGINT << 46) | (least & 70368744112128) | best AS fresh
    FROM (
      SELECT *, least >> 46 AS best, list_position(tokens, least) AS p
      FROM (SELECT *, list_min(tokens) AS least FROM state) WHERE least >> 46 < 65536) s
    LEFT JOIN merges r ON r.pair = best * 65536 + (tokens[p + 2] & 65535)) t
  LEFT JOIN merges l ON l.pair = (before & 65535) * 65536 + best
)
SELECT piece, tokens FROM state ORDER BY piece
"""
DECODE = """
SELECT t.text, unhex(string_agg(v.hex, '' ORDER BY t.pos)) AS bytes, count(v.hex) < count(*) AS unknown
FROM tokens t LEFT JOIN vocabulary v USING (id) GROUP BY t.text ORDER BY t.text
"""


def slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose lengths sum to `most` at most, or single items that are longer."""
    low, total = 0, 0
    for k, n in enumerate(lengths):
        if k > low and total + n > most:
            yield low, k
            low, total = k, 0
        total += n
    if low < len(lengths):
        yield low, len(lengths)


class Codec:
    """Encodes and decodes by a file of ranks (a base64 token and its rank in each line) and a pattern."""

    def __init__(self, ranks_file: str, pattern: str):
        with open(ranks_file, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(self.ranks.values(), default=0) >= 65_536:
            raise ValueError("pairs of ids are held in 32 bits: ranks must be below 65,536")
        self.pattern = regex.compile(pattern)
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.first = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pair_ranks = np.full(65_536, NO_PAIR, np.int32)  # of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pair_ranks[token[0] * 256 + token[1]] = rank
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
        tokens = self.ranks.items()
        pairs = [(self.ranks[t[:k]] * 65_536 + self.ranks[t[k:]], r) for t, r in tokens for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self._table("merges", pair=pa.array([p for p, _ in pairs], pa.int64()), merged=pa.array([m for _, m in pairs], pa.int32()))
        self._table("vocabulary", id=pa.array([r for _, r in tokens], pa.int32()), hex=pa.array([t.hex() for t, _ in tokens], pa.string()))

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS FROM given")
        self.db.unregister("given")

    def _contract(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces."""
        out: list[np.ndarray] = []
        for low in range(0, len(pieces), QUERY_PIECES):
            part = pieces[low : low + QUERY_PIECES]
            offsets = np.cumsum([0, *map(len, part)]).astype(np.int32)
            flat = np.frombuffer(b"".join(part), np.uint8)
            tokens = np.full(len(flat), NO_PAIR, np.int64)
            tokens[:-1] = self.pair_ranks[flat[:-1].astype(np.int32) * 256 + flat[1:]]
            tokens[offsets[1:] - 1] = NO_PAIR  # not across two pieces
            at = np.arange(len(flat)) - np.repeat(offsets[:-1], np.diff(offsets))
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens << 46 | at << 16 | self.first[flat]))
            self._table("pieces", piece=pa.array(np.arange(len(part))), tokens=tokens)
            found = self.db.sql(ENCODE).to_arrow_table()["tokens"].combine_chunks()
            values, ends = (found.values.to_numpy() & 65_535).astype("<u4"), found.offsets.to_numpy()
            out += [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return out

    def _text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def _joined(self, pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of each pair's whole text, from the ids of its two halves."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(pairs)
        left, near = list(range(len(pairs))), NEAR
        while left:
            middles = self._contract([self._text(pairs[k][0][-near:]) + self._text(pairs[k][1][:near]) for k in left])
            again = []
            for k, new in zip(left, middles, strict=True):
                x, y = pairs[k]
                if (len(x) <= near or new[0] == x[-near]) and (len(y) <= near or new[-1] == y[near - 1]):
                    out[k] = np.concatenate([x[:-near], new, y[near:]])
                else:
                    again.append(k)
            left, near = again, 4 * near
        return out

    def _long(self, piece: bytes) -> np.ndarray:
        parts = self._contract([piece[k : k + SEGMENT_BYTES] for k in range(0, len(piece), SEGMENT_BYTES)])
        while len(parts) > 1:
            joined = self._joined(list(zip(parts[::2], parts[1::2], strict=False)))
            parts = joined + parts[len(parts) - len(parts) % 2 :]
        return parts[0]

    def _ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of pieces that are no tokens themselves."""
        short = [p for p in pieces if len(p) <= LONG_BYTES]
        known = dict(zip(short, self._contract(short), strict=True))
        return [(known[p] if p in known else self._long(p)).tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        out: list[bytes] = []
        for low, high in slices([len(t) for t in texts], SLICE_CHARS):
            split = [self.pattern.findall(t) for t in texts[low:high]]
            new = [p for p in set().union(*split) if p not in self.kept]
            if len(self.kept) + len(new) > PIECES_KEPT:
                self.older, self.kept = self.kept, {}
                new = list(set().union(*split))
            known = {p: self.older[p] for p in new if p in self.older}
            self.kept |= known
            new = [p for p in new if p not in known]
            raw = [p.encode() for p in new]
            whole = {p: self.ranks[b].to_bytes(4, "little") for p, b in zip(new, raw, strict=True) if b in self.ranks}
            rest = [(p, b) for p, b in zip(new, raw, strict=True) if p not in whole]
            self.kept |= whole | dict(zip([p for p, _ in rest], self._ids([b for _, b in rest]), strict=True))
            out += [b"".join(map(self.kept.__getitem__, pieces)) for pieces in split]
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each text's bytes."""
        out = [b""] * len(ids)
        filled = [k for k, i in enumerate(ids) if i]
        for low, high in slices([len(ids[k]) // 4 for k in filled], QUERY_IDS):
            part = filled[low:high]
            sizes = np.array([len(ids[k]) // 4 for k in part])
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tokens = np.frombuffer(b"".join(ids[k] for k in part), "<u4").astype(np.int32)
            self._table("tokens", text=pa.array(np.repeat(np.arange(len(part)), sizes)), pos=pa.array(at), id=pa.array(tokens))
            found = self.db.sql(DECODE).to_arrow_table()
            if any(found["unknown"].to_pylist()):
                raise ValueError("an id is not in the vocabulary")
            for k, value in zip(part, found["bytes"].to_pylist(), strict=True):
                out[k] = value
        return out


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: str, pattern: str) -> Codec:
    """The worker's codec of this vocabulary."""
    key = (ranks_file, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(*key)
    return _CODECS[key]


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` with _bpe_ids: little-endian 32-bit ids of each text."""

    def prepare() -> Callable:
        def run(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(codec(ranks_file, pattern).encode([t or "" for t in texts.to_pylist()]), pa.binary())]

        return run

    return with_arrays(df, "_bpe_ids binary", [text], prepare)


def decode(df: DataFrame, ranks_file: str, pattern: str, ids: str = "_bpe_ids") -> DataFrame:
    """`df` with _bpe_bytes: the bytes that the ids stand for."""

    def prepare() -> Callable:
        def run(column: pa.Array) -> list[pa.Array]:
            return [pa.array(codec(ranks_file, pattern).decode([i or b"" for i in column.to_pylist()]), pa.binary())]

        return run

    return with_arrays(df, "_bpe_bytes binary", [ids], prepare)


def round_trip(df: DataFrame, ranks_file: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` with _bpe_ids and _bpe_bytes: encoded, and decoded from the ids, by the same worker and its one codec."""

    def prepare() -> Callable:
        def run(texts: pa.Array) -> list[pa.Array]:
            own = codec(ranks_file, pattern)
            ids = own.encode([t or "" for t in texts.to_pylist()])
            return [pa.array(ids, pa.binary()), pa.array(own.decode(ids), pa.binary())]

        return run

    return with_arrays(df, "_bpe_ids binary, _bpe_bytes binary", [text], prepare)
