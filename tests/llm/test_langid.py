import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from ferrowick.llm import langid, q_langid

from . import cases


def brute_bits(texts, text):
    """Code length of `text` after counting `texts`, byte by byte."""
    counts = defaultdict(Counter)
    for t in texts:
        padded = b"\n\n\n" + t
        for i in range(3, len(padded)):
            for k in range(4):
                counts[padded[i - k : i]][padded[i]] += 1
    bits, padded = 0.0, b"\n\n\n" + text
    for i in range(3, len(padded)):
        for k in (3, 2, 1, 0):
            seen = counts.get(padded[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if padded[i] in seen:
                bits += math.log2(total / seen[padded[i]])
                break
            bits += math.log2(total / len(seen))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(monkeypatch):
    monkeypatch.setattr(langid, "WINDOW_BYTES", 7)
    samples = {"a": [b"banana bandana", b"ab", b"x", b"\n\nban"], "b": ["über unter".encode(), b"q"], "c": []}
    trees = langid.train(samples)
    texts = [b"", b"ban", b"a", b"\xff\xfe", b"", "banana über".encode(), b"nnnn\n\n\nba", b"xy", b""]
    flat = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.code_lengths(trees, trees.nodes(), flat, np.cumsum([0, *map(len, texts)]))
    want = [[brute_bits(samples[x], t) for x in "abc"] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = q_langid.op9_language_id(spark, sf).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_edge_texts(spark, tmp_path):
    docs = cases.documents(spark, cases.EDGE_TEXTS + ["123 456", "é"], extra=True)
    rows = {r["doc_id"]: r for r in q_langid.op9_language_id(spark, cases.folder(spark, tmp_path, documents=docs)).collect()}
    for k, text in enumerate(cases.EDGE_TEXTS + ["123 456", "é"]):
        letter = any(c.isalpha() for c in text or "")
        assert (rows[k]["lang_pred"] == "und") == (not letter) and 0 <= rows[k]["score"] <= 1


def test_null_id_is_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "hello there", "en"), (1, "hello you", "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in q_langid.op9_language_id(spark, cases.folder(spark, tmp_path, documents=docs)).collect()}
    assert rows[None]["held_out"] is True and rows[1]["held_out"] == (zlib.crc32(b"1") % 5 == 0)


def test_empty_table_and_no_labels(spark, tmp_path):
    assert q_langid.op9_language_id(spark, cases.folder(spark, tmp_path / "a", documents=cases.documents(spark, []))).count() == 0
    docs = spark.createDataFrame([(1, "hello", None), (2, None, "en")], "doc_id long, text string, lang string")
    rows = q_langid.op9_language_id(spark, cases.folder(spark, tmp_path / "b", documents=docs)).collect()
    assert {r["lang_pred"] for r in rows} == {"und"}
