import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

from . import cases
from .test_lines import key_of
from .test_ngram import brute as brute_groups
from .test_secrets import brute as brute_secrets


def brute_lines(texts):
    held = {}
    for k, t in texts.items():
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 20:
                held.setdefault(key_of(line), set()).add(k)
    gone = {line: max(docs) for line, docs in held.items() if len(docs) >= 3}
    return {k: "\n".join(x for x in (t or "").split("\n") if gone.get(key_of(x), k) == k) for k, t in texts.items()}


def brute_redacted(text):
    out, at = [], 0
    for start, _, _, stop in brute_secrets(text):
        if start >= at:
            out += [text[at:start], "[secret]"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def test_stages_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = dict(texts)
    steps = [
        lambda t: {k: x for k, x in t.items() if re.search(r"[^\W\d_]", x or "")},
        brute_lines,
        lambda t: {k: t[k] for k, (_, c) in brute_groups(t).items() if c == k},
        lambda t: {k: brute_redacted(x) for k, x in t.items()},
    ]
    for (name, stage), step in zip(corpus_pipeline.STAGES, steps, strict=False):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        out.write.parquet(path := corpus_pipeline.new_path(spark, "test"))
        docs = spark.read.parquet(path)
        rows = docs.collect()
        want = step(want)
        assert {r["doc_id"]: r["text"] for r in rows} == want, name
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {k: len(own.encode(t, add_special_tokens=False).ids) + 1 for k, t in want.items()}
    packed = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == lengths


def test_edge_texts_run_through(spark, tmp_path):
    texts = cases.EDGE_TEXTS + cases.random_texts(10) + ["token=abcdef é été une phrase"]
    sf = cases.folder(spark, tmp_path / "a", documents=cases.documents(spark, texts, extra=True))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert ids and ids <= {k for k, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    sf = cases.folder(spark, tmp_path / "b", documents=cases.documents(spark, []))
    assert corpus_pipeline.run(spark, sf).count() == 0
