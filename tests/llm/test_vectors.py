import math

import numpy as np
import pytest

from ferrowick.llm import q_vectors, vectordup
from ferrowick.llm.components import connected_components

from . import cases


def union(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    good = [(k, lab, np.array(v, float)) for k, v, lab in rows if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a], good[b]
            if x[1] == y[1] and len(x[2]) == len(y[2]) and x[2] @ y[2] / np.linalg.norm(x[2]) / np.linalg.norm(y[2]) >= 0.98:
                links.append((x[0], y[0]))
    count = {k: 0 for k, *_ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    return {k: (count[k], c, k == c) for k, c in union(count, links).items()}


def clustered(seed=3, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for lab in range(3):
        for _ in range(12):
            centre = rng.standard_normal(dim)
            for _ in range(rng.integers(1, 9)):
                rows.append((len(rows), [float(x) for x in np.float32(centre + 0.09 * rng.standard_normal(dim))], lab))
    rows += [(1000 + k, v, lab) for k, (_, v, lab) in enumerate(rows[:10])]
    odd = [(None, 0), ([], 0), ([0.0] * dim, 0), ([None] + [1.0] * (dim - 1), 0), ([math.nan] + [1.0] * (dim - 1), 0), ([math.inf] + [1.0] * (dim - 1), 0), (rows[0][1], None), ([1.0, 2.0], 0), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([3e38] * dim, 0), ([1e-30] * dim, 0)]
    return rows + [(2000 + k, v, lab) for k, (v, lab) in enumerate(odd)]


def result(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS size", "2 AS rep", "3 AS code")
    out = q_vectors.op3_embedding_dedup(spark, cases.folder(spark, tmp_path, embeddings=df)).collect()
    assert len(out) == len(rows)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in out}


@pytest.mark.parametrize("page", [512, 3])
def test_matches_brute_force(spark, tmp_path, page, monkeypatch):
    monkeypatch.setattr(vectordup, "PAGE", page)
    rows = clustered()
    got, want = result(spark, tmp_path, rows), brute(rows)
    linked = sum(n for n, *_ in want.values())
    assert sum(n for n, *_ in got.values()) >= 0.99 * linked and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert all(got[k] == want[k] for k in want if k >= 1000)


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in q_vectors.op3_embedding_dedup(spark, sf).collect()}
    want = brute(rows)
    assert sum(n for n, *_ in got.values()) >= 0.99 * sum(n for n, *_ in want.values())


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    turn = vectordup.rotations(32, 64)
    x, y = rng.standard_normal((2, 4000, 32))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, x + 0.3 * y))
    signs, factor = np.sign(x @ turn.T), np.abs(x @ turn.T).sum(axis=1)
    error = (signs * (y @ turn.T)).sum(axis=1) / factor - (x * y).sum(axis=1)
    f = factor / len(turn) ** 0.5 / 2**0.5
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= vectordup.SPREAD * np.sqrt((1 - f**2) / f**2 / (len(turn) - 1))).mean() > 0.999


def test_empty_table(spark, tmp_path):
    assert result(spark, tmp_path, []) == {}


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2060)] + [(5, 5), (9000, 9000)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == union({n for pair in links for n in pair}, links)
