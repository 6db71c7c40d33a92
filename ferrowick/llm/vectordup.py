"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector x is rotated by seeded random orthogonal matrices; its code is the signs of the rotated coordinates, its
stored factor their sum of absolute values. For another unit vector y, rotated but not coded, the sum of y's coordinates
under x's signs divided by x's factor is an unbiased estimate of their inner product, with an error of at most
`spread` * sqrt((1 - f * f) / f / f / (bits - 1)), f being the factor scaled to the code's length. Pairs whose estimate
plus its bound stays under the threshold are dropped; all others are recomputed exactly in double precision.

Pairs are met in blocks: vectors of one label that agree on one of several bands of code bits. The number of bits in a
band follows the largest label's size, the number of bands from the chance at which a pair just at the threshold
may agree on none (`miss`). A pair that agrees on several bands is counted in the first. Blocks of over PAGE vectors are
cut into pages and compared page by page, so no task holds more than two pages of a block. Of the links in a
block only each vector's count and one edge to its cluster leave the task, never the pairs.

Equal vectors are one class from the start and are not compared with each other.

Defined results: vectors that are null, empty, zero or have null or non-finite components, and those of a null label,
link with nothing; vectors of different lengths don't link; repeated rows are vectors of their own; vec_id null has
component null; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

PAGE = 512
#: Standard deviations of the error bound.
SPREAD = 4.0


def bands_for(largest: int, threshold: float, miss: float = 1e-3) -> tuple[int, int]:
    """(bands, bits in each) for labels of at most `largest` vectors: blocks of some 32 vectors where these are spread evenly."""
    bits = min(max(math.ceil(math.log2(max(largest, 1) / 32 + 1)), 6), 24)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - agree)), bits


def rotations(dim: int, bits: int) -> np.ndarray:
    """At least `bits` rows, in stacked orthogonal matrices."""
    rng = np.random.default_rng(dim)
    return np.vstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))])


def bit_bands(codes: np.ndarray, bands: int, bits: int) -> np.ndarray:
    """The bands of sign bits as integers."""
    return codes[:, : bands * bits].reshape(len(codes), bands, bits).astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))


def encode(vectors: DataFrame, bands: int, bits: int) -> DataFrame:
    """(rep, size, label, dim, vec) rows with their code, factor and bands."""
    schema = "rep long, size long, grp long, dim int, vec binary, code binary, factor double, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(3).to_numpy()
            raw = batch.column(4).to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                if dim not in held:
                    held[dim] = rotations(dim, bands * bits)
                x = np.array([raw[k] for k in at.tolist()], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                turned = unit @ held[dim].T
                signs = turned >= 0
                chosen = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *chosen.columns[:4],
                        pa.array([u.tobytes() for u in unit], pa.binary()),
                        pa.array([c.tobytes() for c in np.packbits(signs, axis=1)], pa.binary()),
                        pa.array(np.abs(turned).sum(axis=1)),
                        pa.array(list(bit_bands(signs, bands, bits)), pa.list_(pa.int64())),
                    ],
                    ["rep", "size", "grp", "dim", "vec", "code", "factor", "bands"],
                )

    return vectors.select("rep", "size", "grp", "dim", "vec").mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys in sorted batches, and where in each table its runs begin (and the last ends)."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows, bool)
        for name in keys:
            values = table[name].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist()]
        if len(cuts) > 1:
            yield table.slice(0, cuts[-1]), cuts
        rest = table.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted batches, each as one table."""
    for table, cuts in grouped(batches, keys):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield table.slice(a, b - a)


def block_links(block: pa.Table, turn: np.ndarray, bits: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) in one block of pairs that link and are met here first."""
    page, p, q, band = block["page"].to_numpy(), block["p"][0].as_py(), block["q"][0].as_py(), block["band"][0].as_py()
    left, right = np.flatnonzero(page == p), np.flatnonzero(page == q)
    unit = np.frombuffer(b"".join(block["vec"].to_pylist()), np.float64).reshape(len(block), -1)
    codes = np.unpackbits(np.frombuffer(b"".join(block["code"].to_pylist()), np.uint8).reshape(len(block), -1), axis=1)[:, : len(turn)]
    signs, turned, factor = (codes * 2.0 - 1).astype(np.float32), (unit @ turn.T).astype(np.float32), block["factor"].to_numpy()
    scaled = factor / math.sqrt(len(turn)) / math.sqrt(len(turn) / unit.shape[1])
    bound = SPREAD * np.sqrt(np.maximum(1 - scaled**2, 0) / scaled**2 / max(len(turn) - 1, 1))
    one = signs[left] @ turned[right].T / factor[left][:, None] + bound[left][:, None]
    two = (signs[right] @ turned[left].T / factor[right][:, None] + bound[right][:, None]).T
    near = (one >= threshold) & (two >= threshold)
    if p == q:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    if band:
        bands = np.array(block["bands"].to_pylist())[:, :band]
        first = ~(bands[i] == bands[j]).any(axis=1)
        i, j = i[first], j[first]
    exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
    return i[exact], j[exact]


def clusters(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of n positions, the smallest id linked with it through the pairs."""
    least = ids.copy()
    while True:
        now = least.copy()
        np.minimum.at(now, i, least[j])
        np.minimum.at(now, j, least[i])
        if (now == least).all():
            return least
        least = now


def compare(blocks: DataFrame, bands: int, bits: int, threshold: float) -> DataFrame:
    """(rep, links, to): what each block adds to a class's links, and an edge into its cluster."""
    keys = ["grp", "dim", "band", "bucket", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0
        for block in whole_groups(batches, keys):
            if len(block) > 1:
                dim = block["dim"][0].as_py()
                if dim not in held:
                    held[dim] = rotations(dim, bands * bits)
                i, j = block_links(block, held[dim], bits, threshold)
                if len(i):
                    rep, size = block["rep"].to_numpy(), block["size"].to_numpy()
                    links = np.zeros(len(rep), np.int64)
                    np.add.at(links, i, size[j])
                    np.add.at(links, j, size[i])
                    used = links > 0
                    out.append((rep[used], links[used], clusters(len(rep), i, j, rep)[used]))
                    waiting += int(used.sum())
            if waiting > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "to"])
                out, waiting = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["rep", "links", "to"])

    columns = [*keys, "page", "rep", "size", "vec", "code", "factor", "bands"]
    return blocks.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rep long, links long, to long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row."""
    unknown = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("lab").isNotNull() & (F.size("vec") > 0) & ~unknown & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("lab"), F.col(vector).cast("array<double>").alias("vec"))
    rows = rows.withColumn("usable", usable & F.col("vec_id").isNotNull()).withColumns({"h1": F.xxhash64("lab", "vec"), "h2": F.xxhash64(F.lit(1), "lab", "vec")})
    classes = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"))
    classes = stored(classes, "vector-classes")
    # Rows that share the smallest id of a class would give it twice; one of them is enough.
    heads = rows.where("usable").join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])
    heads = heads.select(F.struct("h1", "h2").alias("class"), "rep", "size", F.xxhash64("lab").alias("grp"), F.size("vec").alias("dim"), "vec")
    largest = heads.groupBy("grp", "dim").count().agg(F.max("count")).first()[0] or 0
    bands, bits = bands_for(largest, threshold)
    coded = stored(encode(heads, bands, bits), "vector-codes")
    banded = coded.select("*", F.posexplode("bands").alias("band", "bucket"))
    place = ["grp", "dim", "band", "bucket"]
    pages = banded.groupBy(*place).agg(F.ceil(F.count("*") / PAGE).cast("int").alias("pages"), F.count("*").alias("n")).where("n > 1")
    page = F.pmod(F.xxhash64("rep"), F.col("pages")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("pages") - 1))
    blocks = banded.join(pages, place).withColumn("page", page).withColumn("other", other).withColumns({"p": F.least("page", "other"), "q": F.greatest("page", "other")})
    found = stored(compare(blocks, bands, bits, threshold), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "rep")
    known = classes.join(counts, "rep", "left").join(groups, "rep", "left")
    known = known.select("h1", "h2", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    # A key that is null where a row links with nothing keeps such rows out of the join.
    sides = rows.select("vec_id", *[F.when(F.col("usable"), F.col(h)).alias(h) for h in ("h1", "h2")])
    return sides.join(known, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"), (F.coalesce("c", "vec_id") == F.col("vec_id")).alias("kept")
    )
