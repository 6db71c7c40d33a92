"""Language identification by prediction by partial matching.

For each language a variable-order byte context tree (orders 0 to 3) is counted on a bounded sample of labelled
texts. A byte costs -log2 of its frequency in the longest context that the language has seen; each context where
it was not seen adds the cost of an escape (method C: distinct followers against all followers) and hands on to the
next shorter one, down to a uniform order -1. Statistics are frozen after training, so each (context, byte) has one
exact cost for every language; these costs are one table, and a text's code length is a sum of lookups over its
whole length. The language with the shortest code is predicted; `score` is its posterior under equal priors.

The sample is bounded by `docs_per_language` documents of at most `doc_bytes` bytes in each language, those with the
smallest hashes of their ids; the table by `table_bytes`, for which the rarest order-3 contexts go.

Defined results: `und` and score 0 if text is null or has no letter, or if nothing was learnt; ties go to the language
that sorts first; documents of a null language or of null text teach nothing; repeated rows are predicted each;
an empty table gives no rows. Texts are read in windows, so a very long one needs no more memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import forget_model, text_bytes, with_arrays

UNDETERMINED = "und"
ORDER = 3
#: A text starts as after three line feeds.
BEFORE = 10
WINDOW_BYTES = 1 << 19


@dataclass(frozen=True)
class ContextTrees:
    """`codes[k]`: sorted contexts of order k + 1 as integers; `costs`: bits by node, byte and language. Node 0 is the root."""

    languages: tuple[str, ...]
    codes: tuple[np.ndarray, ...]
    costs: np.ndarray

    def nodes(self) -> np.ndarray:
        """The longest known context's node for every three bytes."""
        found, first = np.zeros(1, np.uint16), 1
        for k, codes in enumerate(self.codes):
            found = np.tile(found, 256)
            found[codes] = first + np.arange(len(codes))
            first += len(codes)
            assert len(found) == 256 ** (k + 1)
        return found


def contexts(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """The three bytes before each position from low to high, as integers, texts kept apart. starts, ends: of texts that aren't empty."""
    back = np.full(high - low + ORDER, BEFORE, np.int32)
    have = max(low - ORDER, 0)
    back[ORDER - (low - have) :] = flat[have:high]
    out = back[:-3] << 16 | back[1:-2] << 8 | back[2:-1]
    near = (starts < high) & (starts >= low - ORDER)
    for k in range(ORDER):
        at = starts[near & (starts + k < ends)] + k
        at = at[(at >= low) & (at < high)]
        own = np.full(len(at), 0, np.int32)
        for j in range(ORDER):  # bytes at - 3, at - 2, at - 1
            own = own << 8 | (flat[at - ORDER + j].astype(np.int32) if j >= ORDER - k else np.int32(BEFORE))
        out[at - low] = own
    return out


def train(samples: dict[str, list[bytes]], table_bytes: int = 32 << 20) -> ContextTrees:
    """Count the trees and fill in the costs."""
    languages = tuple(sorted(samples))
    counted = []  # by language: sorted (context, byte) codes of order 3 and their counts
    for language in languages:
        texts = [t for t in samples[language] if t]
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        starts = ends - np.array([len(t) for t in texts], np.int64)
        codes = contexts(flat, starts, ends, 0, len(flat)).astype(np.int64) << 8 | flat
        counted.append(np.unique(codes, return_counts=True))
    levels, room = [], max(table_bytes // (256 * 4 * max(len(languages), 1)), 1)
    for order in range(1, ORDER + 1):
        weights: dict[int, int] = {}
        for codes, n in counted:
            kinds, where = np.unique(codes >> 8 & (1 << 8 * order) - 1, return_inverse=True)
            for kind, weight in zip(kinds.tolist(), np.bincount(where, n).tolist(), strict=True):
                weights[kind] = weights.get(kind, 0) + weight
        left = min(room - 1 - sum(map(len, levels)), 65_535 - sum(map(len, levels)))
        best = sorted(weights, key=lambda c: (-weights[c], c))[: max(left, 0)]
        levels.append(np.array(sorted(best), np.int64))
    total = 1 + sum(map(len, levels))
    costs = np.full((total, 256, len(languages)), 8.0, np.float32)
    for j, (codes, n) in enumerate(counted):
        above = np.full((1, 256), 8.0)
        first, nodes = 0, np.zeros(1, np.int64)
        for order in range(ORDER + 1):
            if order:
                nodes = levels[order - 1]
                if order == 1:
                    parents = np.zeros(len(nodes), np.int64)
                else:
                    parents = np.searchsorted(levels[order - 2], nodes & (1 << 8 * (order - 1)) - 1)
                    short = levels[order - 2]
                    parents = np.minimum(parents, max(len(short) - 1, 0))
                rows = above[parents].copy() if len(nodes) else np.zeros((0, 256))
            else:
                rows = above.copy()
            followers, where = np.unique(codes & (1 << 8 * (order + 1)) - 1, return_inverse=True)
            seen = np.bincount(where, n, len(followers))
            owner = followers >> 8
            at = np.searchsorted(nodes, owner)
            at = np.minimum(at, max(len(nodes) - 1, 0))
            known = nodes[at] == owner if len(nodes) else np.zeros(len(owner), bool)
            at, seen, byte = at[known], seen[known], (followers & 255)[known]
            all_n, kinds = np.bincount(at, seen, len(nodes)), np.bincount(at, minlength=len(nodes))
            here = kinds > 0
            rows[here] += np.log2((all_n[here] + kinds[here]) / kinds[here])[:, None]
            rows[at, byte] = np.log2((all_n[at] + kinds[at]) / seen)
            costs[first : first + len(nodes), :, j] = rows
            first, above = first + len(nodes), rows
    return ContextTrees(languages, tuple(levels), costs)


def code_lengths(trees: ContextTrees, nodes: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(offsets) - 1, len(trees.languages)))
    filled = np.flatnonzero(np.diff(offsets))
    starts, ends = offsets[filled], offsets[filled + 1]
    table = trees.costs.reshape(-1, len(trees.languages))
    for low in range(0, len(flat), WINDOW_BYTES):
        high = min(low + WINDOW_BYTES, len(flat))
        rows = nodes[contexts(flat, starts, ends, low, high)].astype(np.int32) * 256 + flat[low:high]
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        sums = np.add.reduceat(table[rows], np.maximum(starts[first:last], low) - low, axis=0, dtype=np.float64)
        out[filled[first:last]] += sums
    return out


def sample(docs: DataFrame, docs_per_language: int, doc_bytes: int, key: str, text: str, lang: str) -> dict[str, list[bytes]]:
    """The labelled texts with the smallest hashes, a bounded number of bounded size."""
    usable = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= doc_bytes)).select(F.col(lang).alias("l"), F.col(key).alias("k"), F.xxhash64(key).alias("h"))
    chosen = usable.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k"))).where(F.col("r") <= docs_per_language)
    ids = F.broadcast(chosen.select("k").distinct())  # docs_per_language rows a language at most
    rows = docs.where(F.col(lang).isNotNull() & (F.octet_length(text) <= doc_bytes)).join(ids, F.col(key) == F.col("k")).select(F.col(lang).alias("l"), F.col(text).cast("binary").alias("t")).distinct().collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r["l"], bytes(r["t"]))):
        out.setdefault(r["l"], []).append(bytes(r["t"]))
    return out


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 200, doc_bytes: int = 20_000, table_bytes: int = 32 << 20) -> ContextTrees:
    """Trees of every language in `docs`."""
    return train(sample(docs, docs_per_language, doc_bytes, key, text, lang), table_bytes)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """`docs` with _lang_pred, _lang_score and _lang_bits (bits a byte of the best code)."""
    held = docs.sparkSession.sparkContext.broadcast(trees)  # at most table_bytes and its codes

    def prepare():
        forget_model()
        trees = held.value
        nodes, names = trees.nodes(), [*trees.languages, UNDETERMINED]

        def predict(texts: pa.Array, letters: pa.Array) -> list[pa.Array]:
            flat, offsets = text_bytes(texts)
            ok = np.asarray(letters.to_numpy(zero_copy_only=False), bool) & bool(trees.languages)
            if not trees.languages:
                n = len(texts)
                return [pa.array([UNDETERMINED] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n))]
            bits = code_lengths(trees, nodes, flat, offsets)
            best = bits.argmin(axis=1)
            least = bits.min(axis=1)
            share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
            chosen = np.where(ok, best, len(trees.languages))
            return [pa.array(names, pa.string()).take(pa.array(chosen)), pa.array(np.where(ok, share, 0.0)), pa.array(np.where(ok, least / np.maximum(np.diff(offsets), 1), 0.0))]

        return predict

    with_letters = docs.withColumn("_lang_letter", has_letter(F.col(text)))
    return with_arrays(with_letters, "_lang_pred string, _lang_score double, _lang_bits double", [text, "_lang_letter"], prepare).drop("_lang_letter")
