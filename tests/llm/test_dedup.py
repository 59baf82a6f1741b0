"""Exact and near deduplication against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from terrashift.llm import shingles as shingles_module
from terrashift.llm.components import components
from terrashift.llm.exact_dedup import exact_groups
from terrashift.llm.near_dedup import NearSpec, near_groups
from terrashift.llm.shingles import superminhash

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, kept string, component_id int"


def shingles(text: str | None) -> frozenset:
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near(df) -> dict[int, tuple[int, int]]:
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df).collect()}


def test_near_groups_of_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = near_groups(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_groups_of_chains_and_odd_rows(spark):
    """A chain of drifting copies, copies of two to many, short texts, nulls, and columns named like the result."""
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(4000)]
    rows: list[tuple[int, str | None]] = [(1, None), (2, ""), (3, " \t "), (4, "Two Words"), (5, "two words"), (6, "two")]
    text = list(rng.choice(word, 120))
    for i in range(40):
        rows.append((100 + i, " ".join(text)))
        text = text[3:] + list(rng.choice(word, 3))
    base = list(rng.choice(word, 60))
    for i in range(80):
        t = list(base)
        t[int(rng.integers(60))] = f"x{i}"
        rows.append((300 + i, " ".join(t)))
    rows += [(500 + i, "Same text, told again and again in MANY places") for i in range(30)]
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    assert near(df) == brute(rows)


def test_a_passage_that_many_documents_share(spark):
    """Documents around the threshold that hold one long passage, or one of two that overlap, beside remainders of all sizes."""
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    rows: list[tuple[int, str | None]] = []
    for i in range(260):
        head, tail = int(rng.integers(0, 14)), int(rng.integers(0, 14))
        body = passage[: 60 - 6 * (i % 3)] if i % 2 else passage
        fresh = [f"u{i}x{j}" for j in range(head + tail)]
        if i % 11 == 0 and rows:
            fresh[:head] = [f"u{i - 11}x{j}" for j in range(head)]
        rows.append((i, " ".join(fresh[:head] + body + fresh[head:])))
    assert near(spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)) == brute(rows)


def test_near_groups_of_nothing(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_groups(spark.createDataFrame([(None, "a b c d e f", "x", 1), (1, "a b c d e f", "x", 1)], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.kept) for r in got) == [(False, True), (True, True)]


def test_a_very_long_text(spark):
    long = " ".join(f"t{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, "", 0), (2, long + " end", "", 0), (3, "short one", "", 0)], SCHEMA)
    assert near(df) == {1: (299_996, 1), 2: (299_997, 1), 3: (1, 3)}


def _peak_mb(code: str) -> float:
    """Growth of a fresh process's peak memory while ``code`` runs after the imports and the input."""
    setup = """
import resource, numpy as np, pyarrow as pa
from terrashift.llm import shingles as S
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
text = " ".join(np.array([f"w{i}é" for i in range(60_000)])[np.arange(4_000_000) * 7919 % 59_999])
batch = pa.array([text]); del text
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", setup + "before = peak()\n" + code + "\nprint(peak() - before)"], cwd=root, capture_output=True, text=True, check=True)
    return float(out.stdout)


def test_memory_of_a_text_of_30_mb():
    """The 4 million words' hashes, the shingles and the sort take some 60 bytes a word; nothing else grows."""
    assert _peak_mb("assert sum(len(s) for _, s in S.text_sets(pa.array([1]), batch)) > 50_000") < 330


def test_words_hash_alike_at_every_piece_length(monkeypatch):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abXYé"), int(rng.integers(1, 9)))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocab, int(n))) for n in (0, 1, 7, 300, 9000)] + ["", " \t ", "Q" * 70_000 + " a b", "é" * 900 + "\n"]
    whole = [w.tolist() for w in shingles_module.text_words(pa.array(texts))]
    low = [w.tolist() for w in shingles_module.text_words(pa.array([t.lower() for t in texts]), lower=False)]
    assert whole == low and [len(w) for w in whole] == [len(t.split()) for t in texts]
    for size in (48, 1000, 1 << 14):
        monkeypatch.setattr(shingles_module, "CHUNK", size)
        shingles_module._POWERS.clear()
        assert [w.tolist() for w in shingles_module.text_words(pa.array(texts))] == whole
    monkeypatch.undo()
    shingles_module._POWERS.clear()


@pytest.mark.parametrize("n", [3, 40, 900])
def test_signature_agreement_estimates_similarity(n):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(30):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = pool[: n + n // 2], pool[n // 2 : 2 * n]
        true = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        errors.append((superminhash(a, 112) == superminhash(b, 112)).mean() - true)
    assert abs(np.mean(errors)) < 0.04


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert NearSpec().percent == 75


def test_exact_groups_of_odd_rows(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, ""), (6, "a "), (2, "a"), (None, "b"), (None, "z"), (9, "ä" * 50_000)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = exact_groups(df, digest=True).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[t or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in want if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        known = [i for i in want[text] if i is not None]
        assert (r.keep_id, r.group_size) == (max(known, default=None), len(want[text]))
        assert r.kept == (r.doc_id == r.keep_id)
    assert exact_groups(spark.createDataFrame([], SCHEMA)).count() == 0
