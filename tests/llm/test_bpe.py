import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from ferrowick.llm import bpe, q_bpe

from . import cases


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(q_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(reference, text):
    ids = b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(text or ""))
    return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_matches_tiktoken(spark, tmp_path, reference):
    texts = cases.EDGE_TEXTS + cases.random_texts() + ["<|endoftext|> ok", " \n \t x", "a\x1cb\x1f", "ΑΣ ας 你好世界 مرحبا", "\n" * 300, "aaaa" * 50]
    rows = q_bpe.op4_byte_bpe(spark, cases.folder(spark, tmp_path, documents=cases.documents(spark, texts, extra=True))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(reference, texts[r["doc_id"]]), texts[r["doc_id"]]


def test_matches_tiktoken_on_documents(spark, sf_dir, reference):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in q_bpe.op4_byte_bpe(spark, sf_dir).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == expected(reference, texts[r["doc_id"]])


def test_bounded_pieces_and_unknown_ids(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 3)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 10)
    monkeypatch.setattr(bpe, "QUERY_PIECES", 2)
    own = bpe.Codec(public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    texts = ["onreherea thonings", "", "onreherea blentings", "thonings ouiereaux"]
    assert own.decode(own.encode(texts)) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        own.decode([(60_000).to_bytes(4, "little")])


def test_a_piece_that_recurs_is_encoded_once(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_KEPT", 4)
    own = bpe.Codec(public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    seen, contract = [], own._contract
    monkeypatch.setattr(own, "_contract", lambda pieces: seen.extend(pieces) or contract(pieces))
    texts = [f" onreherea qzx{a}{b}vw jkq{b}{a}zz" for a in "abcdef" for b in "ghijkl"]
    assert [own.encode([t])[0] for t in texts] == [b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t)) for t in texts]
    assert seen.count(b" onreherea") == 1 and len(own.kept) + len(own.older) <= 2 * 4


def test_leftmost_of_equal_ranks_and_all_lengths(reference):
    own = bpe.Codec(public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(6)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("a", "ab", "thea", "\u00e9a", "=-") for n in range(1, 120)]
    assert own.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t)) for t in texts]


def test_long_pieces(reference, monkeypatch):
    own = bpe.Codec(public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "é日a") for n in (300, 3000)]
    texts += ["a" * n for n in (257, 1000, 1001)] + ["ab" * 700, "the" * 500, "!" * 999, "=-" * 400, "\n" * 700]
    assert own.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t)) for t in texts]
    for name, value in (("LONG_BYTES", 5), ("SEGMENT_BYTES", 2), ("NEAR", 2)):
        monkeypatch.setattr(bpe, name, value)
    own.kept.clear()
    texts = [t or "" for t in cases.EDGE_TEXTS + cases.random_texts(30) if len(t or "") < 2000]
    texts += ["".join(rng.choice(letters) for _ in range(n)) for letters in ("etaoin", "a", "ab", "thers") for n in range(6, 40)]
    assert own.encode(texts) == [b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(t)) for t in texts]


def test_a_word_of_two_hundred_thousand_letters(reference):
    own = bpe.Codec(public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    assert own.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in reference.encode_ordinary(text))


def test_encode_and_decode_apart(spark):
    using = (public_tokenizers.path(q_bpe.VOCABULARY), public_tokenizers.PATTERN)
    df = cases.documents(spark, cases.random_texts(5) + [None])
    rows = bpe.decode(bpe.encode(df, *using), *using).collect()
    assert all(r["_bpe_bytes"] == (r["text"] or "").encode() for r in rows)


def test_empty_table(spark, tmp_path):
    assert q_bpe.op4_byte_bpe(spark, cases.folder(spark, tmp_path, documents=cases.documents(spark, []))).count() == 0
