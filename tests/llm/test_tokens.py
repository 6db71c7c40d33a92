import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ferrowick.llm import packing, q_packing, q_shards, shards, tokens

from . import cases

TEXTS = cases.EDGE_TEXTS + cases.random_texts() + ["<|endoftext|><|startoftext|>", "hi <|endoftext|> there, a<|endoftext|>b", " \n \t x", "a\x1cb\x1f \n", "ΑΣ ας É E\u0301 \u0301x 你好", "a  \n b\u00a0 \n\u2003c", "\x85 a"]
ALPHABET = st.sampled_from(list(" \n\t\r\x0b\x1c\u00a0\u0301aAéß'sd12!#🙂") + ["don't", "a.'s ", "b,.", "\u200b", "ing", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof"])


def whole(name):
    own = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: np.array(own.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize(("name", "keeps"), [(q_packing.VOCABULARY, True), (q_shards.VOCABULARY, False)])
def test_chunks_equal_whole_texts(name, keeps, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 300)
    monkeypatch.setattr(tokens, "CHUNKS_KEPT", 500)
    own, reference = tokens.Encoder(public_tokenizers.path(name), keeps), whole(name)
    texts = [t or "" for t in TEXTS]
    assert own.encode(pa.array(texts)) == [reference(t) for t in texts]
    assert own.encode(pa.array([None, "a", None], pa.string()).slice(1)) == [reference("a"), b""]

    @settings(max_examples=1500, deadline=None)
    @given(st.lists(ALPHABET, max_size=20).map("".join))
    def check(text):
        assert own.encode(pa.array([text, "x", text])) == [reference(text), reference("x"), reference(text)]

    check()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=40), st.sampled_from([16, 64, 128]))
def test_packing_covers_each_token_once(lengths, size):
    pieces = packing.pack(lengths, size, packing.Cost())
    docs, sequences = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in pieces:
        docs[doc].append((start, n))
        sequences[sequence].append((offset, n))
    for parts, ends in ((docs, dict(enumerate(lengths))), (sequences, dict(enumerate(packing.capacities(sum(lengths), size))))):
        assert parts.keys() == ends.keys()
        for k, spans in parts.items():
            at = 0
            for start, n in sorted(spans):
                assert start == at and n > 0
                at += n
            assert at == ends[k]


def test_packing_balances_cost():
    rng = random.Random(1)
    cost, totals = packing.Cost(), defaultdict(float)
    for _, _, n, sequence, _ in packing.pack([rng.randrange(50, 900) for _ in range(500)], 2048, cost):
        totals[sequence] += cost(n)
    full = sorted(totals.values())[8:]
    assert full[-1] < 1.6 * full[len(full) // 2]


def test_packing_query(spark, tmp_path):
    sf = cases.folder(spark, tmp_path, documents=cases.documents(spark, TEXTS, extra=True))
    reference, rows = whole(q_packing.VOCABULARY), q_packing.op7_packing(spark, sf).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = reference(TEXTS[r["doc_id"]]) + b"\1\0\0\0"
        assert r["doc_tokens"] == len(ids) // 4
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])])
        docs[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert docs.keys() == set(range(len(TEXTS)))
    assert all(sum(n for _, n, _ in spans) == spans[0][2] for spans in docs.values())
    padding = 0
    for spans in sequences.values():
        assert [a for a, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))]
        total = sum(n for _, n in spans)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0


def test_shards_query(spark, tmp_path):
    sf = cases.folder(spark, tmp_path, documents=cases.documents(spark, TEXTS, extra=True).repartition(5))
    reference, start = whole(q_shards.VOCABULARY), 0
    for r in sorted(q_shards.op6_token_shards(spark, sf).collect()):
        ids = reference(TEXTS[r["doc_id"]]) + b"\2\0\0\0"
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert r["doc_id"] == len(TEXTS) - 1


def test_shard_lookup(tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_BYTES", 64)
    keys = [None, -(2**63), -5, -5, 0, 7, 7, 7, 7, 7, 7, 7, 7, 2**40, 2**63 - 1]
    values = [np.arange(k + 3, dtype="<u2") for k in range(len(keys))]
    with open(tmp_path / "s", "wb") as sink:
        writer = shards.ShardWriter(sink, 2)
        for k, v in zip(keys, values, strict=True):
            writer.add(shards.key_bytes(k), v.tobytes())
        writer.close()
    reader = shards.ShardReader(f"file://{tmp_path}/s")
    assert [shards.key_of(k) for k, _ in reader] == keys and (reader.entries, reader.ids) == (15, sum(map(len, values)))
    for key in set(keys):
        assert [x.tolist() for x in reader.get(key)] == [v.tolist() for k, v in zip(keys, values, strict=True) if k == key]
    assert reader.get(6) == [] and reader.get(-6) == []
    assert sum(reader.may_hold(shards.key_bytes(k)) for k in range(100, 1100)) < 100


def test_repeated_and_null_ids_and_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([(3, "b"), (3, "a"), (None, "n"), (3, None), (1, "")], "doc_id long, text string")
    sf = cases.folder(spark, tmp_path / "a", documents=docs)
    rows = sorted(q_shards.op6_token_shards(spark, sf).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 3, 3, 3]
    assert len({r["sequence_id"] for r in q_packing.op7_packing(spark, sf).collect()}) >= 1
    sf = cases.folder(spark, tmp_path / "b", documents=cases.documents(spark, []))
    assert q_shards.op6_token_shards(spark, sf).count() == q_packing.op7_packing(spark, sf).count() == 0


def test_a_worker_gives_back_memory_when_its_task_ends(spark):
    from pathlib import Path

    import pyarrow as pa

    from ferrowick.llm.arrowtext import tidy

    def own_mb():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) / 1024

    def uses(batches):
        for _ in batches:
            pieces = [b"x" * 900 for _ in range(300_000)]  # some 280 MB that the C library keeps
            last = pieces[-1]
            del pieces
            yield pa.RecordBatch.from_arrays([pa.array([float(len(last))])], ["v"])

    def grown(batches):
        before = own_mb()
        list(tidy(uses)(batches))
        yield pa.RecordBatch.from_arrays([pa.array([own_mb() - before])], ["v"])

    assert spark.range(1).coalesce(1).mapInArrow(grown, "v double").first()["v"] < 60


def test_a_worker_keeps_one_encoder_and_little_besides_its_chunks(spark):
    from pathlib import Path

    def own_mb():
        return sum(int(x.split()[1]) for x in Path("/proc/self/smaps_rollup").read_text().splitlines() if x.startswith("Pss_Anon:")) / 1024

    paths = public_tokenizers.path(q_packing.VOCABULARY), public_tokenizers.path(q_shards.VOCABULARY)

    def grown(batches):
        rng, most = random.Random(1), 0.0
        own = tokens.encoder(paths[0], True)
        own.encode(pa.array(["begin"]))
        before = own_mb()
        for _ in range(8):
            own.encode(pa.array([" ".join("".join(rng.choices("abcdefghij", k=10)) for _ in range(60)) for _ in range(1000)]))
            most = max(most, own_mb() - before)
        tokens.encoder(paths[1], False)
        again = tokens.encoder(paths[0], True) is not own
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([again])], ["v", "again"])

    row = spark.range(1).coalesce(1).mapInArrow(grown, "v double, again boolean").first()
    assert row["again"] and row["v"] < 110, row
