"""N-gram Jaccard join with a count-vector R-tree.

A document's set is its distinct 5-word shingles. Shingles are hashed into groups; the counts of a set's shingles in
each group are a point, and the overlap of two sets is at most the sum of the coordinates' minima. Two sets link when
their Jaccard similarity is at least LEAST, which needs an overlap of (sizes' sum) * LEAST / (1 + LEAST).

The tree has three levels; the upper two are tables, so that their search is joins:

* Root. With MASS_GROUPS groups nearly every coordinate of a point is 0 or 1. Coordinates (shingles) are ordered by the
  mass of their group in the whole corpus, rare first. Two points that reach the overlap share a coordinate among the
  first quarter of either, so each such coordinate is an entry of the root, and points meet only under shared entries.
  Passages that very many documents share lie last in that order and are entries for hardly any. Large sets share not
  one but an eighth of the larger set's size among their first three eighths, so for them an entry in 2, 4, 8 ... is enough, chosen
  by the shingle's hash: SHARED are expected in common, and the chance of none, exp(-SHARED), is below that of equal hashes.
* Bands. Under an entry, points of sizes in a ratio of BAND share a band; only neighbouring bands can link. A band of
  over PAGE points is dealt over pages by a hash of the document.
* Boxes. The points of a page are halved again and again at the median of the coordinate that varies most, down to LEAF
  points. A box is the maximum of each coordinate and the least size in it. Points descend into those boxes whose
  summed minima reach the overlap.

A point has at least as many coordinates as its set has shingles, a power of two, so that the bound tells long documents
apart as well as short ones; points of more coordinates are folded to as many as the other has. Surviving pairs are verified
on the whole sets. Work follows from what is known already:

1. Equal sets are one class; one representative of each goes on.
2. Under each entry all points are compared with the smallest document id there: as many pairs as points.
3. Where the links found so far leave an entry with points of several components, those outside its largest component
   descend the boxes of all its points for partners in other components. No other pair can change a component, so no
   link is lost. First each point takes its best partner only; once these links are known, all pairs that are
   still in different components are taken. So a group that many pairs join costs a pair for each of its members.

Defined results: null or blank texts and those without words have an empty set and link with nothing; texts with fewer
than five words have their whole word sequence as one shingle; rows that share an id are one node of the graph; rows of
null id link with nothing and have a null component; an empty table gives no rows. Only MASS_GROUPS sums and a filter of FILTER_BITS reach the
driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrowtext import SLICE_ROWS, text_bytes, tidy, with_arrays
from .common import Scratch, stored
from .components import connected_components
from .shingles import Hasher, text_slices
from .vectordup import grouped

# The similarity as a ratio of integers.
LEAST = (75, 100)
#: Groups whose mass orders the root's entries: the upper bits of a hash.
MASS_BITS = 16
MASS_GROUPS = 1 << MASS_BITS
#: Sets of twice SAMPLED or more have a part of their entries: of those with two, four ... times SAMPLED, every second, fourth ... one.
SHARED = 40
SAMPLED = 8 * SHARED
#: Fewest coordinates of a point, and the count that stands for a coordinate that doesn't fit.
COARSE = 64
FULL = 15
#: Sizes of linked sets are in a ratio of 4/3 at most, so they are in one band or in neighbouring ones.
BAND = 1.35
PAGE = 512
LEAF = 16
#: Bytes compared at once.
ROOM = 1 << 24
#: Size of the filter that finds the documents to verify: 2 MB.
FILTER_BITS, FILTER_HASHES = 1 << 24, 4


def group_mass(docs: DataFrame, text: str) -> np.ndarray:
    """Number of shingles in each group over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, mass = Hasher(), np.zeros(MASS_GROUPS, np.int64)
        for batch in batches:
            for _, _, flat, offsets in text_slices(*text_bytes(batch.column(0))):
                mass += np.bincount(hasher.shingles(flat, offsets)[0] >> np.uint64(64 - MASS_BITS), minlength=MASS_GROUPS)
        used = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(mass[used])], ["grp", "n"])

    out = np.zeros(MASS_GROUPS, np.int64)
    for r in docs.select(text).mapInArrow(tidy(run), "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():  # MASS_GROUPS rows at most
        out[r["grp"]] = r["n"]
    return out


def ranks_of(mass: np.ndarray) -> np.ndarray:
    """Each group's place in the order of mass, as a hash's upper bits."""
    ranks = np.empty(MASS_GROUPS, np.uint64)
    ranks[np.argsort(mass, kind="stable")] = np.arange(MASS_GROUPS, dtype=np.uint64)
    return ranks << np.uint64(64 - MASS_BITS)


def ordered_sets(texts: pa.Array, hasher: Hasher, ranks: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's set in the order of the root's entries, as integers that sort in that order."""
    lower = np.uint64((1 << 64 - MASS_BITS) - 1)
    for _, _, flat, offsets in text_slices(*text_bytes(texts)):
        hashes, at = hasher.shingles(flat, offsets)
        hashes = ranks[hashes >> np.uint64(64 - MASS_BITS)] | (hashes & lower)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield np.unique(hashes[a:b])


def entries_of(own: np.ndarray) -> np.ndarray:
    """The root's entries of a set in order: its first quarter, or part of its first three eighths where it or a partner may be sampled."""
    n = len(own)
    first = n - -(-n * LEAST[0] // LEAST[1]) + (n > 0)
    if n * LEAST[1] < 2 * SAMPLED * LEAST[0]:  # no partner has 2 * SAMPLED
        return own[:first]
    every = 1 << max((n // SAMPLED).bit_length() - 1, 0)
    own = own[: first + -(-n // 8)]
    return own[(own >> np.uint64(20)) % np.uint64(every) == 0]


def point_of(own: np.ndarray) -> bytes:
    """Counts in four bits each, the first half of the coordinates in the lower bits; a point with a count that doesn't fit is
    FULL everywhere and bounds nothing."""
    coordinates = max(COARSE, 1 << max(len(own) - 1, 0).bit_length())
    counts = np.bincount((own % np.uint64(coordinates)).astype(np.int64), minlength=coordinates)
    low, high = (counts if counts.max() < FULL else np.full(coordinates, FULL)).astype(np.uint8).reshape(2, -1)
    return (low | high << 4).tobytes()


def points_of(raw: list[bytes]) -> np.ndarray:
    """One row for each point, all folded to the fewest coordinates among them."""
    least = 2 * min(map(len, raw), default=COARSE // 2)
    out = np.empty((len(raw), least), np.uint16)
    for k, p in enumerate(raw):
        packed = np.frombuffer(p, np.uint8)
        counts = np.concatenate([packed & 15, packed >> 4])
        out[k] = counts if len(counts) == least else counts.reshape(-1, least).sum(axis=0, dtype=np.uint16)
    return out


def may_reach(na, nb, overlap):
    """Whether an overlap of `overlap` or less lets sets of these sizes link."""
    return overlap * (LEAST[0] + LEAST[1]) >= LEAST[0] * (na + nb)


def may_link(x: np.ndarray, y: np.ndarray, nx, ny) -> np.ndarray:
    """Whether points (or a point and a box) of these sizes may link: no overlap exceeds the sum of minima, nor a set's size."""
    return may_reach(nx, ny, np.minimum(np.minimum(x, y).sum(axis=-1, dtype=np.int64), nx))


def descend(points: np.ndarray, n: np.ndarray, queries: np.ndarray, items: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, item) positions that may link, by boxes over the items."""
    todo = [(queries, items)]
    while todo:
        q, rows = todo.pop()
        if len(rows) > LEAF:
            box = points[rows]
            q = q[may_link(points[q], box.max(axis=0), n[q], n[rows].min())]
            if len(q):
                order = rows[np.argsort(box[:, box.var(axis=0).argmax()], kind="stable")]
                todo += [(q, order[: len(order) // 2]), (q, order[len(order) // 2 :])]
            continue
        step = max(ROOM // (2 * LEAF * points.shape[1]), 1)
        for part in (q[k : k + step] for k in range(0, len(q), step)):
            near = may_link(points[part][:, None], points[rows][None], n[part][:, None], n[rows][None])
            near &= may_reach(n[part][:, None], n[rows][None], n[rows][None])
            i, j = np.nonzero(near)
            yield part[i], rows[j]


def sketches(docs: DataFrame, ranks, key: str, text: str) -> DataFrame:
    """doc_id, n (size of the set), s1 and s2 (its digest), point and entries of every document."""
    held = docs.sparkSession.sparkContext.broadcast(ranks)  # MASS_GROUPS integers

    def prepare():
        hasher = Hasher()

        def run(texts: pa.Array) -> list[pa.Array]:
            n, s1, s2, points, entries = [], [], [], [], []
            for own in ordered_sets(texts, hasher, held.value):
                digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), "<i8")
                n.append(len(own))
                s1.append(digest[0])
                s2.append(digest[1])
                points.append(point_of(own))
                entries.append(entries_of(own).view(np.int64))
            return [pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(points, pa.binary()), pa.array(entries, pa.list_(pa.int64()))]

        return run

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    return with_arrays(rows, "n long, s1 long, s2 long, point binary, entries array<long>", ["body"], prepare).drop("body")


def stars(points: DataFrame, scratch: Scratch) -> DataFrame:
    """(entry, hub, doc_id, n): every point under an entry with a smaller id, and the smallest there.

    Minima are aggregated before they are dealt out, and joined back from a table, a plain join that can be split where very many share
    an entry.
    """
    rows = points.select(F.explode("entries").alias("entry"), "doc_id", "n")
    shared = rows.groupBy("entry").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    return rows.join(scratch.stored(shared.select("entry", "hub"), "hubs"), "entry").where("doc_id <> hub")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The (a, b) pairs whose points may reach the overlap. Hubs are `a`, and joined last: only ids are dealt out by them before."""
    side = lambda k: points.select(F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("point").alias(f"p{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where(may_reach(F.col("na"), F.col("nb"), F.least("na", "nb")))

    def prepare():
        def run(na: pa.Array, nb: pa.Array, pa_: pa.Array, pb: pa.Array) -> list[pa.Array]:
            na, nb, x, y = na.to_numpy(), nb.to_numpy(), pa_.to_pylist(), pb.to_pylist()
            least = np.array([min(len(i), len(j)) for i, j in zip(x, y, strict=True)], np.int64)
            out = np.zeros(len(na), bool)
            for size in np.unique(least).tolist():
                at = np.flatnonzero(least == size)
                step = max(ROOM // (4 * size), 1)
                for part in (at[k : k + step] for k in range(0, len(at), step)):
                    both = points_of([x[k] for k in part.tolist()] + [y[k] for k in part.tolist()])
                    out[part] = may_link(both[: len(part)], both[len(part) :], na[part], nb[part])
            return [pa.array(out)]

        return run

    return with_arrays(both, "may boolean", ["na", "nb", "pa", "pb"], prepare).where("may").select("a", "b")


def member_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of ids with FILTER_BITS bits: at most FILTER_BITS / 64 rows reach the driver."""
    places = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]))
    words = nodes.select(places.alias("b")).groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(pmod(b, 64) AS INT))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        out[r["w"]] = r["bits"]
    return out.view(np.uint64)


def whole_sets(docs: DataFrame, nodes: DataFrame, ranks, key: str, text: str) -> DataFrame:
    """doc_id and the whole set of the given nodes.

    Texts aren't dealt out: a filter of bounded size finds the documents to hash, and a join drops those it let
    through by chance. Where there are so many nodes that it lets all through, all are hashed.
    """
    context = docs.sparkSession.sparkContext
    held, members = context.broadcast(ranks), context.broadcast(member_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words = Hasher(), members.value
        for batch in (b.slice(k, SLICE_ROWS) for b in batches for k in range(0, b.num_rows, SLICE_ROWS)):
            places = np.stack([batch.column(k).to_numpy() for k in range(2, 2 + FILTER_HASHES)])
            inside = ((words[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
            some = batch.filter(pa.array(inside))
            if some.num_rows:
                sets = list(ordered_sets(some.column(1), hasher, held.value))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], schema.names)

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("body"))
    rows = rows.select("doc_id", "body", *[F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.lit(FILTER_BITS)).alias(f"b{k}") for k in range(FILTER_HASHES)])
    schema = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("shingles array<long>").fields])
    return rows.mapInArrow(tidy(run), schema).join(nodes, "doc_id", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) pairs that link."""
    side = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"s{k}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    overlap = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("overlap"))
    return overlap.where(may_reach(F.col("na"), F.col("nb"), F.col("overlap"))).select("a", "b")


def open_entries(members: DataFrame) -> DataFrame:
    """(entry, home): entries with points of several components, and the component of most. `members`: entry, doc_id, c.

    A passage gives many entries with the same points; one of them stands for all.
    """
    same = [F.sum(F.xxhash64(F.lit(k), "doc_id").cast("decimal(38,0)")).alias(f"x{k}") for k in range(2)]
    parts = members.groupBy("entry", "c").agg(F.count("*").alias("k"), *same)
    totals = [F.sum(f"x{k}").alias(f"x{k}") for k in range(2)]
    entries = parts.groupBy("entry").agg(F.sum("k").alias("m"), F.count("*").alias("kinds"), F.max_by("c", F.struct("k", "c")).alias("home"), *totals).where("kinds > 1")
    return entries.groupBy("m", "x0", "x1").agg(F.min(F.struct("entry", "home")).alias("one")).select("one.*")


def blocks(members: DataFrame, points: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of (entry, band, p, q): page q of all points of a band under an open entry, and page p of those that look for
    partners there (`asks`): the points outside the entry's home component, of that band or a neighbouring one."""
    cell = ["entry", "band"]
    band = F.floor(F.log("n") / math.log(BAND)).cast("int")
    under = members.join(open_entries(members), "entry").withColumns({"stray": F.col("c") != F.col("home"), "band": band}).drop("home").distinct()
    asking = under.where("stray").withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.col("band") + 1)))
    rows = asking.withColumn("asks", F.lit(True)).unionByName(under.withColumn("asks", F.lit(False)))
    pages = lambda which: F.ceil(F.count(F.when(which, 1)) / PAGE).cast("int")
    cells = rows.groupBy(*cell).agg(pages(F.col("asks")).alias("ps"), pages(~F.col("asks")).alias("qs")).where("ps > 0 and qs > 0")
    own = lambda n: F.array(F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = rows.join(scratch.stored(cells, "cells"), cell).withColumn("p", F.explode(F.when(F.col("asks"), own("ps")).otherwise(every("ps"))))
    dealt = dealt.withColumn("q", F.explode(F.when(F.col("asks"), every("qs")).otherwise(own("qs")))).drop("ps", "qs")
    return dealt.join(points.select("doc_id", "n", "point"), ["doc_id", "n"])


def block_pairs(rows: DataFrame, best_only: bool) -> DataFrame:
    """(entry, a, b, score): asking points and those of other components that they may link with; with `best_only`, for each
    asking point the one in its block with the highest bound for its size."""
    keys = ["entry", "band", "p", "q"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in grouped(batches, keys):
            found: list[tuple[np.ndarray, ...]] = []
            entries, n, c, doc, stray, asks = (table[x].to_numpy() for x in ("entry", "n", "c", "doc_id", "stray", "asks"))
            raw = table["point"].to_pylist()
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                points, own = points_of(raw[low:high]), slice(low, high)
                best = np.zeros(high - low)
                partner = np.full(high - low, -1)
                for i, j in descend(points, n[own], np.flatnonzero(asks[own]), np.flatnonzero(~asks[own])):
                    # Two asking points would find each other twice.
                    kept = (c[own][i] != c[own][j]) & ~(stray[own][j] & (doc[own][j] < doc[own][i]))
                    i, j = i[kept], j[kept]
                    score = np.minimum(points[i], points[j]).sum(axis=1, dtype=np.int64) / (n[own][i] + n[own][j])
                    if not best_only:
                        found.append((np.full(len(i), entries[low]), doc[own][i], doc[own][j], score))
                        continue
                    order = np.argsort(score, kind="stable")  # the last of a point is its best
                    i, j, score = i[order], j[order], score[order]
                    at = score > best[i]
                    best[i[at]], partner[i[at]] = score[at], j[at]
                if best_only:
                    i = np.flatnonzero(partner >= 0)
                    found.append((np.full(len(i), entries[low]), doc[own][i], doc[own][partner[i]], best[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["entry", "a", "b", "score"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(tidy(run), "entry long, a long, b long, score double")


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row, as a written table."""
    with Scratch(docs.sparkSession) as scratch:
        return stored(_groups(docs, key, text, scratch), "ngram-groups")


def _groups(docs: DataFrame, key: str, text: str, scratch: Scratch) -> DataFrame:
    ranks = ranks_of(group_mass(docs, text))
    full = scratch.stored(sketches(docs, ranks, key, text), "sketches")
    own = scratch.stored(full.select("doc_id", "n", "s1", "s2"), "digests")
    filled = full.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.stored(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep")), "set-classes")
    heads = scratch.stored(filled.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), ["doc_id", "s1", "s2"], "left_semi").select("doc_id", "n", "point", "entries"), "heads")
    scratch.free(full)
    met = scratch.stored(stars(heads, scratch), "stars")
    nodes = met.select("doc_id").unionByName(met.select(F.col("hub").alias("doc_id"))).distinct()
    points = scratch.stored(heads.join(nodes, "doc_id", "left_semi").select("doc_id", "n", "point").dropDuplicates(), "points")
    scratch.free(heads)

    def check(pairs: DataFrame) -> DataFrame:
        """The links among pairs."""
        ends = scratch.stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ends")
        sets = scratch.stored(whole_sets(docs, ends, ranks, key, text), "sets")
        links = scratch.stored(verified(pairs, sets), "links")
        scratch.free(ends, sets)
        return links

    tried = scratch.stored(bounded(met.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct(), points), "star-pairs")
    links = check(tried)
    for best_only in (True, False):
        groups = connected_components(links).withColumnRenamed("node", "doc_id")
        members = scratch.stored(met.join(groups, "doc_id", "left").select("entry", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "members")
        found = scratch.stored(block_pairs(blocks(members, points, scratch), best_only), "block-pairs")
        scratch.free(members)
        # The best of an asking point over all blocks.
        chosen = found.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b")) if best_only else found
        more = scratch.stored(chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "more-pairs")
        if not more.isEmpty():
            links = scratch.stored(links.unionByName(check(more)), "links")
            tried = scratch.stored(tried.unionByName(more), "tried")
        # Components only grow, so entries without a pair now have none later.
        met = met.join(found.select("entry").distinct(), "entry", "left_semi")

    groups = connected_components(links).withColumnRenamed("node", "rep")
    known = classes.join(groups, "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    # Rows that link with nothing have no digest to join on.
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    rows = own.select("doc_id", "n", *[F.when(~alone, F.col(s)).alias(s) for s in ("s1", "s2")])
    return rows.join(known, ["s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
