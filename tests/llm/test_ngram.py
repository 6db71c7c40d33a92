import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ferrowick.llm import ngramjoin, q_ngram, shingles

from . import cases
from .test_vectors import union


def shingle_set(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def brute(texts):
    """By document: size and component, all pairs that share a shingle compared."""
    sets, held = {k: shingle_set(t) for k, t in texts.items()}, defaultdict(list)
    for k, s in sets.items():
        for x in s:
            held[x].append(k)
    common = defaultdict(int)
    for docs in held.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    return {k: (len(sets[k]), c) for k, c in union(texts, links).items()}


def variants(rng, n_groups=12):
    vocabulary = [f"w{k}" for k in range(60)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 250))]
        for _ in range(rng.randrange(1, 12)):
            words = list(base)
            for _ in range(rng.randrange(0, max(len(base) // 25, 2))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                words += passage
            texts.append((" " if rng.random() < 0.8 else "\n").join(words))
    return texts


def result(spark, tmp_path, texts):
    sf = cases.folder(spark, tmp_path, documents=cases.documents(spark, texts, extra=True))
    rows = q_ngram.op1_ngram_join(spark, sf).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize(("page", "leaf"), [(512, 16), (5, 2)])
def test_matches_brute_force(spark, tmp_path, page, leaf, monkeypatch):
    monkeypatch.setattr(ngramjoin, "PAGE", page)
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    texts = variants(random.Random(page)) + cases.EDGE_TEXTS + cases.random_texts(20) + ["ONE two three four FIVE", "one  two\nthree four five"]
    assert result(spark, tmp_path, texts) == brute(dict(enumerate(texts)))


def test_matches_brute_force_on_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q_ngram.op1_ngram_join(spark, sf_dir).collect()} == brute(texts)


def test_chain_whose_hub_links_with_one_end_only(spark, tmp_path):
    words = [f"v{k}" for k in range(400)]
    chain = [" ".join(words[20 * k : 20 * k + 200]) for k in range(10)]
    assert result(spark, tmp_path, chain) == brute(dict(enumerate(chain)))


def test_repeated_null_ids_and_empty_table(spark, tmp_path):
    text = "one two three four five six"
    docs = spark.createDataFrame([(7, text), (7, text), (3, text), (None, text), (None, None), (4, None)], "doc_id long, text string")
    rows = q_ngram.op1_ngram_join(spark, cases.folder(spark, tmp_path / "a", documents=docs)).collect()
    assert sorted((tuple(r) for r in rows), key=str) == sorted([(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, None), (None, 0, None), (4, 0, 4)], key=str)
    assert q_ngram.op1_ngram_join(spark, cases.folder(spark, tmp_path / "b", documents=cases.documents(spark, []))).count() == 0


def doubled(spark, tmp_path, texts):
    docs = cases.documents(spark, texts)
    rows = q_ngram.op1_ngram_join(spark, cases.folder(spark, tmp_path, documents=docs.unionByName(docs))).collect()
    assert len(rows) == 2 * len(texts)
    found = {tuple(r) for r in rows}
    assert len(found) == len(texts)
    return {d: (n, c) for d, n, c in found}


def test_every_row_doubled(spark, tmp_path):
    def words(of, n):
        return [f"{of}{k}" for k in range(n)]

    # Edits of parts of one template: x and y link, so do z and w, and both pairs meet only under the template's entries.
    template = [words("a", 100) + words("b", 100), *(words(part, 100) + words(tail, 12) for part, tail in ("ax", "ay", "bz", "bw"))]
    texts = [" ".join(x) for x in template]
    assert doubled(spark, tmp_path / "template", texts) == brute(dict(enumerate(texts)))
    chain = [" ".join(words("v", 400)[20 * k : 20 * k + 200]) for k in range(10)]
    texts = chain + variants(random.Random(5))
    assert doubled(spark, tmp_path / "more", texts) == brute(dict(enumerate(texts)))


def test_points_bound_overlaps():
    rng = np.random.default_rng(1)
    for size in (10, 900, 5000):
        a, b = (np.unique(rng.integers(0, size * 2, size)).astype(np.uint64) for _ in range(2))
        b = b[: len(b) * 4 // 5]
        both = ngramjoin.points_of([ngramjoin.point_of(s) for s in (a, b)])
        assert np.minimum(*both).sum() >= len(np.intersect1d(a, b))
    crowded = np.arange(600, dtype=np.uint64) << np.uint64(20)
    assert set(ngramjoin.point_of(crowded)) == {255}
    assert (ngramjoin.points_of([ngramjoin.point_of(crowded)]) == ngramjoin.FULL).all()


def test_large_sets_share_entries():
    rng = np.random.default_rng(3)
    for size in (470, 490, 650, 1300, 5000, 40_000):
        for ratio in (0.75, 0.86, 1.0):
            b = np.unique(rng.integers(0, 1 << 63, size)).astype(np.uint64)
            overlap = -(-3 * (len(b) + int(ratio * len(b))) // 7)  # the least that links
            others = np.unique(rng.integers(0, 1 << 63, max(int(ratio * len(b)) - overlap, 0))).astype(np.uint64)
            a = np.sort(np.concatenate([b[len(b) - overlap :], others // np.uint64(2)]))  # shares the last ones, what's its own comes first
            shared = len(np.intersect1d(ngramjoin.entries_of(a), ngramjoin.entries_of(b)))
            assert shared >= (10 if size > 480 else 1)
            assert len(ngramjoin.entries_of(b)) < 330


def test_long_documents_match_brute_force(spark, tmp_path):
    rng, texts = random.Random(11), []
    for size in (500, 620, 700, 1500, 4000):
        base = [f"u{rng.randrange(10**6)}" for _ in range(size)]
        for share in (0.0, 0.01, 0.02, 0.03, 0.035, 0.04):
            texts.append(" ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base))
        texts += [" ".join(base[: size * k // 100]) for k in (74, 76, 80)]
    assert result(spark, tmp_path, texts) == brute(dict(enumerate(texts)))


@pytest.mark.parametrize("leaf", [2, 16])
def test_boxes_miss_no_pair(leaf, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LEAF", leaf)
    monkeypatch.setattr(ngramjoin, "ROOM", 1 << 12)
    rng = np.random.default_rng(2)
    bases = [rng.integers(0, 1 << 60, 300) for _ in range(8)]
    sets = [np.unique(np.concatenate([rng.choice(bases[k % 8], 260, replace=False), rng.integers(0, 1 << 60, k % 90)])).astype(np.uint64) for k in range(160)]
    points, n = ngramjoin.points_of([ngramjoin.point_of(s) for s in sets]), np.array([len(s) for s in sets])
    found = set()
    for i, j in ngramjoin.descend(points, n, np.arange(0, 160, 3), np.arange(160)):
        found |= set(zip(i.tolist(), j.tolist(), strict=True))
    want = set()
    for i in range(0, 160, 3):
        for j in range(160):
            overlap = len(np.intersect1d(sets[i], sets[j]))
            if 100 * overlap >= 75 * (n[i] + n[j] - overlap):
                want.add((i, j))
    assert want <= found
    assert len(found) < 54 * 160 / 3


def test_shingles_of_slices(monkeypatch):
    monkeypatch.setattr(shingles, "SLICE_BYTES", 16)
    texts = [t or "" for t in cases.EDGE_TEXTS + cases.random_texts(10)]
    raw = [t.encode() for t in texts]
    flat, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    hasher, names = shingles.Hasher(), {}
    for low, high, part, own in shingles.text_slices(flat, offsets):
        hashes, at = hasher.shingles(part, own)
        for k in range(low, high):
            mine = set(hashes[at[k - low] : at[k - low + 1]].tolist())
            want = shingle_set(texts[k])
            assert len(mine) == len(want)
            names[frozenset(mine)] = names.get(frozenset(mine), frozenset(want))
            assert names[frozenset(mine)] == want
