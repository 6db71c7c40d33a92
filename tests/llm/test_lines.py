import hashlib
import re
from collections import defaultdict

from ferrowick.llm import linededup, q_lines

from . import cases


def key_of(line):
    bare = re.sub(r"\A[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in bare)


def brute(texts):
    held = defaultdict(set)
    for k, t in enumerate(texts):
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                held[key_of(line)].add(k)
    out = {}
    for k, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key_of(x), ())) < 3 or max(held[key_of(x)]) == k]
        out[k] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


LINE = "This is a LINE of over twenty characters"
TEXTS = [LINE, f"a\n  {LINE.lower()}\t\n{LINE}\nb", f"\x0b{LINE}\r\nshort\nshort", "short\nshort", "x" * 20, "X" * 20 + " ", f"{'x' * 20}\n{LINE}\n", "é" * 20, "é" * 20, "É" * 20, " " + "é" * 20, "é" * 19 + "\n" + "é" * 19]


def test_matches_brute_force(spark, tmp_path):
    texts = cases.EDGE_TEXTS + TEXTS + cases.random_texts(20) * 3 + cases.EDGE_TEXTS
    sf = cases.folder(spark, tmp_path, documents=cases.documents(spark, texts, extra=True))
    rows = q_lines.op2_line_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows} == brute(texts)
    assert len(rows) == len(texts)


def test_columns_pass_through(spark):
    docs = cases.documents(spark, [LINE] * 4 + [None], extra=True)
    out = linededup.dedup_lines(docs).drop("_line_n_lines", "_line_n_dropped")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(0, ""), (1, ""), (2, ""), (3, LINE), (4, "")]


def test_repeated_rows_and_null_ids(spark):
    docs = spark.createDataFrame([(1, LINE), (1, LINE), (2, LINE), (None, LINE), (None, "x")], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in linededup.dedup_lines(docs).collect()))
    assert got == [(0, ""), (0, "x"), (1, ""), (1, ""), (2, LINE)]


def test_null_ids_count_as_one_document(spark):
    docs = spark.createDataFrame([(None, LINE + "\nown"), (None, LINE), (1, LINE)], "doc_id long, text string")
    assert sorted(r["text"] for r in linededup.dedup_lines(docs).collect()) == [LINE, LINE, LINE + "\nown"]
    got = linededup.dedup_lines(docs.unionByName(spark.createDataFrame([(2, LINE)], "doc_id long, text string"))).collect()
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got)) == [(0, ""), (0, "own"), (1, ""), (2, LINE)]


def test_runs_stay_disjoint_and_few(spark, tmp_path):
    folder = f"{tmp_path}/runs"
    runs = linededup.LineRuns(spark, folder, fanout=2, buckets=4)
    for k in range(5):
        if k == 3:  # opened again
            runs.close()
            runs = linededup.LineRuns(spark, folder, fanout=2)
            assert runs.buckets == 4 and runs.batches == 3
        runs.add(spark.createDataFrame([(i % 7, i % 7, 1, 100 * k + i) for i in range(k, k + 3)], "k1 long, k2 long, n_docs long, last_doc long"))
    keys = [r["k1"] for run in runs.runs() for r in run.collect()]
    assert sorted(keys) == list(range(7)) and sorted(runs.spans) == [(0, 3), (4, 4)]
    assert {r["k1"]: (r["n_docs"], r["last_doc"]) for r in runs.repeated(1).collect()} == {0: (1, 0), 1: (2, 101), 2: (3, 202), 3: (3, 303), 4: (3, 404), 5: (2, 405), 6: (1, 406)}
    runs.close()


def test_later_documents_meet_earlier_lines(spark, tmp_path):
    rows = lambda *ids: spark.createDataFrame([(k, LINE) for k in ids], "doc_id long, text string")
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    folder = f"{tmp_path}/runs"
    assert texts(linededup.dedup_lines(rows(5, 9), folder=folder)) == [(5, LINE), (9, LINE)]
    assert texts(linededup.dedup_lines(rows(3), folder=folder)) == [(3, "")]
    assert texts(linededup.dedup_lines(rows(12, 4), folder=folder)) == [(4, ""), (12, LINE)]


def test_empty_table(spark, tmp_path):
    assert q_lines.op2_line_dedup(spark, cases.folder(spark, tmp_path, documents=cases.documents(spark, []))).count() == 0
