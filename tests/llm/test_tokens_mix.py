"""Token files and source mixing against brute force, and on odd tables."""

from __future__ import annotations

import math
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrashift.llm import mixing, token_store
from terrashift.llm.token_store import Encoder, TokenSpec, WaveletMatrix, token_digest

DATA = "/root/testdata/sf0.001"
SPEC = TokenSpec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
FULL, SHARED = Tokenizer.from_file(SPEC.tokenizer), Encoder(TokenSpec(SPEC.tokenizer, SPEC.pattern, memo_words=50))
ODD = [
    "", " ", "  two  spaces ", "a\n b", "tab\t x", "end ", "<|endoftext|> inside", "x<|y", "null\0 byte", "déjà vu – ﷽ 漢字 🙂🙂",
    "it's we'll 12 345", "one, two,. three!?' four.\nfive é, x1, ß.", "\n\n\n", "a\u00a0b \u00a0c", "é" * 3000,
]


def ids_of(text: str) -> list[int]:
    return [*FULL.encode(text, add_special_tokens=False).ids, 0]


def encoded(encoder: Encoder, texts: list[str]) -> list[list[int]]:
    tokens, counts = encoder.encode(pa.array(texts))
    return [x.tolist() for x in np.split(tokens, np.cumsum(counts)[:-1])]


def test_encoder_equals_the_tokenizer_on_odd_texts():
    want = [ids_of(t) for t in ODD]
    assert encoded(Encoder(SPEC), ODD) == want
    plain = [t for t in ODD if "<|" not in t and not t.endswith(" ")]
    small = Encoder(TokenSpec(SPEC.tokenizer, SPEC.pattern, memo_words=3))
    for _ in range(3):
        assert encoded(small, ODD) == want
        assert encoded(small, plain) == [ids_of(t) for t in plain]


@given(st.lists(st.text(st.sampled_from("abZé ,.!?'\n\t\u00a0\u2003\x1c1漢<|>-"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer(texts):
    assert encoded(SHARED, texts) == [[*FULL.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_token_files_round_trip(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    spec = TokenSpec(SPEC.tokenizer, SPEC.pattern, shard_chars=60_000)
    got = sorted(token_digest(docs, spec).collect())
    at, want = 0, []
    for r in sorted(docs.select("doc_id", "text").collect()):
        ids = ids_of(r.text)
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want


def test_a_vocabulary_that_needs_more_bits_is_refused(monkeypatch):
    monkeypatch.setattr(token_store, "PLANES", 8)
    with pytest.raises(ValueError, match="larger"):
        Encoder(SPEC)


def test_token_files_of_odd_rows(spark):
    rows = [(i, t, "x", 0) for i, t in enumerate(ODD)] + [(100, None, "x", 0), (3, "a\n b", "y", 1)]
    got = token_digest(spark.createDataFrame(rows, "doc_id bigint, text string, start string, n_tokens int"), SPEC).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((i, len(ids_of(t or ""))) for i, t, *_ in rows)
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert token_digest(spark.createDataFrame([], "doc_id bigint, text string"), SPEC).count() == 0


def test_a_shard_of_rare_words_takes_little_memory(monkeypatch):
    """Rows of many bytes are encoded in pieces, and the memo holds no more words than it may."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x:x}" for x in rng.integers(0, 1 << 40, 2000).tolist()) for _ in range(150)]
    spec = TokenSpec(SPEC.tokenizer, SPEC.pattern, memo_words=1000)
    encoder = token_store._encoder(spec)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        (row,) = next(token_store._shard_writer(spec)(iter([batch]))).to_pylist()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert WaveletMatrix.load(row).decode().tolist() == [x for t in texts for x in ids_of(t)]
    assert len(encoder.memo) + len(getattr(encoder, "older", ())) <= 1000
    assert most < 80e6


def test_new_words_of_letters_skip_the_pre_tokenizer():
    """Words of letters, also with marks behind them or a line break between them, go straight to the library's encoding."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdeéßñ漢"), 9)) for _ in range(600)]
    text = " ".join(f"{a}{m}\n{b}{n} {c}{m}" for a, b, c, m, n in zip(words[::3], words[1::3], words[2::3], ["", ".", ",%%%", "###"] * 50, ["&", "", "!"] * 67))
    encoder = Encoder(SPEC)
    whole, given = encoder._whole, []
    encoder._whole = lambda texts: given.extend(texts) or whole(texts)
    assert encoded(encoder, [text, text]) == [ids_of(text)] * 2
    assert sum(map(len, given)) < 100


def test_words_met_again_stay_in_the_memo():
    """Many words that are met once do not drive out those that are met now and then."""
    common = [f"{c}ommon" for c in "abcdefgh"]
    encoder = Encoder(TokenSpec(SPEC.tokenizer, SPEC.pattern, memo_words=64))
    for i in range(40):
        text = " ".join(["x", *(common if i < 2 or i % 8 == 0 else []), *(f"{a}{b}{'q' * i}" for a in "uvwxyz" for b in "klmnoprstu")])
        if i > 2 and i % 8 == 0:
            assert set(common) <= set(encoder.memo.to_pylist())
        assert encoded(encoder, [text]) == [ids_of(text)]
        assert len(encoder.memo) <= 64
    # Those that were met again keep to three quarters: other words that come back find room.
    for _ in range(3):
        text = " ".join(["x", *(f"later{a}{b}" for a in "uvwxyz" for b in "klmnoprstu")])
        assert encoded(encoder, [text]) == [ids_of(text)]
    assert sum(w.startswith("later") for w in encoder.memo.to_pylist()) > 40


@given(st.lists(st.text(st.sampled_from("aBé ,.&#(=-_'\n\t\u00a0\u0301\u20281漢"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_the_tokenizer_on_lines_and_marks(texts):
    assert encoded(SHARED, texts) == [ids_of(t) for t in texts]


@pytest.mark.parametrize("n", [1, 511, 512, 5000])
def test_wavelet_matrix_answers(n):
    rng = np.random.default_rng(n)
    ids = rng.choice([0, 1, 7, 300, 50255, 50256, 65535], n).astype(np.uint16)
    m = WaveletMatrix.load(WaveletMatrix.build(ids).dump())
    assert (m.decode() == ids).all()
    for i in rng.integers(0, n, 20).tolist():
        assert m.access(i) == ids[i]
        assert m.rank(int(ids[i]), i) == (ids[:i] == ids[i]).sum()
    for token in (0, 7, 50256, 12345):
        where = np.flatnonzero(ids == token)
        assert m.count(token) == len(where)
        assert [m.select(token, k) for k in range(min(30, len(where)))] == where[:30].tolist()
        assert m.select(token, len(where)) == -1


def test_lookup_of_a_token(spark):
    docs = spark.createDataFrame([(i, f"word {'again ' * i}end") for i in range(6)], "doc_id bigint, text string")
    path = token_store.scratch_path(spark, "lookup")
    token_store.write_tokens(docs, path, SPEC)
    token = ids_of(" again")[0]
    got = {r.doc_id: r.n for r in token_store.lookup(spark.read.parquet(path), token).collect()}
    assert got == {i: i for i in range(1, 6)}


def mix_rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(900):
        source = "big" if i % 3 else f"s{i % 7}"
        out.append((i, " ".join("w" for _ in range(int(rng.integers(1, 60)))), source, 5))
    return out + [(1000, None, "big", 1), (1001, "", None, 1), (1002, "three null words", None, 1), (1003, " ", "blank", 1)]


SCHEMA = "doc_id bigint, text string, source string, epoch int"


@pytest.mark.parametrize("limit", [1.0, 1.25, 3.0])
def test_mix_reaches_the_repetition_limit(spark, limit):
    rows = mix_rows()
    plan = mixing.mix_plan(spark.createDataFrame(rows, SCHEMA), mixing.MixSpec(max_repeats=limit, block_tokens=2_000)).collect()
    tokens = {i: len((t or "").split()) for i, t, _, _ in rows}
    total: dict = {}
    for i, _, s, _ in rows:
        total[s] = total.get(s, 0) + tokens[i]
    used: dict = {}
    seen = set()
    for r in plan:
        assert r.n_tokens == tokens[r.doc_id] and (r.doc_id, r.epoch) not in seen
        seen.add((r.doc_id, r.epoch))
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    assert {i for i, e in seen if e == 0} == set(tokens)
    small = min((s for s in total if total[s]), key=lambda s: total[s])
    assert used["big"] == total["big"]
    # A budget is met by the document that reaches it.
    assert limit * total[small] - 1e-6 <= used[small] <= limit * total[small] + 60 or math.isclose(limit, 1.0)
    x = 1 - math.log(limit) / math.log(total["big"] / total[small])
    z = sum(v**x for v in total.values() if v)
    for r in plan:
        if r.weight is not None:
            assert math.isclose(r.weight, total[r.source] ** x / z, rel_tol=1e-3)


def test_blocks_hold_the_target_composition(spark):
    plan = mixing.mix_plan(spark.createDataFrame(mix_rows(), SCHEMA), mixing.MixSpec(max_repeats=2.0, block_tokens=4_000))
    cells = plan.where("block between 1 and 4").groupBy("block", "source").agg(F.sum("n_tokens").alias("n"), F.max("weight").alias("w")).collect()
    assert cells
    for r in cells:
        assert abs(r.n - 4_000 * r.w) <= 120


def test_mix_to_an_entropy(spark):
    docs = spark.createDataFrame(mix_rows(), SCHEMA)
    counted = docs.select(F.col("source"), mixing.token_count(F.col("text")).alias("n_tokens")).where("source is not null")
    shares = mixing.source_shares(counted)
    x = mixing.exponent(shares, mixing.MixSpec(max_repeats=None, entropy=0.9))
    w = np.array([r.share**x for r in shares.collect()])
    w /= w.sum()
    assert math.isclose(-(w * np.log(w)).sum() / math.log(len(w)), 0.9, abs_tol=1e-4)


def test_mixed_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(mix_rows(), SCHEMA)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {r.doc_id for r in out.collect()}
    assert got == {r[0] for r in mix_rows()}
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
