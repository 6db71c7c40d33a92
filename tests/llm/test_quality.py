import re
from collections import Counter

from ferrowick.llm import q_quality, quality

from . import cases


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_counts_match_brute_force(spark, tmp_path):
    texts = cases.EDGE_TEXTS + cases.random_texts() + ["a b c a b c d", "a a a a", "a b c x a b c a b"]
    sf = cases.folder(spark, tmp_path, documents=cases.documents(spark, texts, extra=True))
    rows = q_quality.op5_quality_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert not (r["kept"] and r["base_failed"])


def test_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = q_quality.op5_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [r["kept"] for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    junk = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(clean) / len(clean) > 0.97
    assert sum(junk) / len(junk) < 0.1


def test_fit_recovers_accuracies():
    model = quality.fit([((1, 1), 800), ((-1, -1), 150), ((1, -1), 10), ((0, 1), 40)], 2)
    assert 0.7 < model.good < 0.9 and min(model.on_good) >= 0.99 and min(model.on_bad) > 0.8
    assert quality.fit([], 3).on_good == (quality.LEAST_ON_GOOD,) * 3


def test_empty_table(spark, tmp_path):
    assert q_quality.op5_quality_rules(spark, cases.folder(spark, tmp_path, documents=cases.documents(spark, []))).count() == 0
