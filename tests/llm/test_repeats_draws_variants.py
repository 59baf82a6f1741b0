"""Substring dedup, importance resampling and spelling variants against brute force, SQL and on odd tables."""

from __future__ import annotations

import dataclasses
import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.llm import recompress, resample, substring_dedup, variants
from terrashift.llm.queries import QUERIES, SQL
from terrashift.llm.radix import radix_ranks
from terrashift.llm.recompress import ParseSpec, anchors, window_hashes
from terrashift.llm.substring_dedup import repeated_spans, without_repeats
from terrashift.llm.variants import VariantSpec, near_pairs, roots, spelling_variants

DATA = "/root/testdata/sf0.001"
#: Extra columns that bear names of results and of inner columns.
SCHEMA = "doc_id bigint, text string, tag string, name int, n_words string, weight int, word string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 7, "y", 1, "z", 2) for i, t in rows], SCHEMA)


def by_sql(name, **tables):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = con.execute(SQL[name])
    columns = [d[0] for d in out.description]
    return columns, out.fetchall()


@pytest.mark.parametrize("name", ["op11_substrings", "op12_resample", "op13_variants"])
def test_queries_agree_with_their_sql(spark, name):
    columns, want = by_sql(name)
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


# ---- substrings


def brute_repeats(rows, width):
    """Per row: number of words, number removed, digest of the rest."""
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for p in range(len(w) - width + 1):
                s = tuple(w[p : p + width])
                first[s] = min(first.get(s, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and first[tuple(w[p : p + width])] < i:
                gone.update(range(p, p + width))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    return out


def same_repeats(spark, rows, spec=ParseSpec()):
    got = without_repeats(frame(spark, rows), spec).collect()
    want = brute_repeats(rows, spec.window)
    strip = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(strip((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == sorted(strip(r[:4]) for r in want)
    texts = {(r[0], r[3]): r[4] for r in want if r[2]}
    assert all(r.left == texts[r.doc_id, r.kept_sha256] for r in got if r.n_removed)


def test_repeats_at_every_place_and_length(spark):
    """Passages of 45 to 400 words at the start, in the middle, at the end; edited copies; small and large vocabularies."""
    rng = np.random.default_rng(2)
    rows = []
    for vocabulary in (3, 40, 5000):
        word = [f"v{vocabulary}w{i}" for i in range(vocabulary)]
        say = lambda n, word=word: list(rng.choice(word, n))
        passages = [say(int(n)) for n in (45, 49, 50, 51, 60, 77, 130, 400)]
        for _ in range(60):
            body = []
            for _ in range(int(rng.integers(0, 4))):
                body += say(int(rng.integers(0, 40))) + passages[int(rng.integers(len(passages)))]
            body += say(int(rng.integers(0, 30)))
            for _ in range(int(rng.integers(0, 3))):
                if body:
                    body[int(rng.integers(len(body)))] = f"e{rng.integers(1e9)}"
            rows.append((int(rng.integers(0, 10_000)), "  ".join(body)))
    same_repeats(spark, rows)


def test_repeats_in_odd_rows(spark):
    rng = np.random.default_rng(4)
    text = " ".join(rng.choice([f"q{i}" for i in range(300)], 140))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (10, text), (10, text), (10, text + " more"), (11, text), (12, " " + text.upper())]
    rows += [(None, text), (None, None), (13, "la " * 300), (14, "la " * 120 + "end"), (15, "no " + "la la " * 40), (16, "ta ti " * 100), (17, "x ta " + "ti ta " * 40)]
    rows += [(20 + i, text) for i in range(40)] + [(-5, text + " tail"), (90, " ".join(text.split()[:50])), (91, " ".join(text.split()[:49]))]
    same_repeats(spark, rows)
    assert without_repeats(frame(spark, [])).count() == 0
    assert repeated_spans(frame(spark, [])).count() == 0


def test_spans_of_copies_and_passages(spark):
    a = " ".join(f"a{i}" for i in range(200))
    rows = [(1, a), (2, a), (3, "x " + " ".join(a.split()[20:90]) + " y " + " ".join(a.split()[100:150])), (4, a[:100])]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in repeated_spans(frame(spark, rows)).collect()}
    assert got == {2: [(0, 200)], 3: [(1, 71), (72, 122)]}


def test_a_very_long_text_is_parsed_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    long = list(rng.choice([f"w{i}" for i in range(900)], 30_000))
    rows = [(1, " ".join(long)), (2, " ".join(long[7_000:7_400])), (3, " ".join(["new"] + long[8_150:8_260] + ["z"] * 70)), (4, " ".join(long[:9_000] + ["cut"] + long[9_000:]))]
    spec = dataclasses.replace(ParseSpec(), piece=4_096)
    same_repeats(spark, rows, spec)
    words = rng.integers(0, 2**60, 20_000).astype(np.uint64)
    words[5_000:5_060] = words[0]
    whole = anchors(words, np.array([0, len(words)]))
    parts = anchors(words, np.array([0, len(words)]), dataclasses.replace(ParseSpec(), piece=1_000))
    assert [whole.start.tolist(), whole.name.tolist(), whole.lo.tolist(), whole.hi.tolist()] == [parts.start.tolist(), parts.name.tolist(), parts.lo.tolist(), parts.hi.tolist()]
    monkeypatch.setattr(substring_dedup, "PIECE", 64)
    assert [w for p in substring_dedup._pieces(" ä b\tc ".encode() * 40) for w in p] == (" ä b\tc ".encode() * 40).split()


@pytest.mark.parametrize("vocabulary", [2, 5, 60, 10**6])
def test_symbols_follow_from_their_context(vocabulary):
    """Where the words of a symbol's context occur again, so does the symbol: equal substrings share their inside."""
    rng = np.random.default_rng(vocabulary)
    spec = ParseSpec()
    body = rng.integers(0, vocabulary, 4_000).astype(np.uint64)
    around = [np.concatenate([rng.integers(0, vocabulary, 30), body, rng.integers(0, vocabulary, 30)]).astype(np.uint64) for _ in range(2)]
    names = []
    for words in around:
        s = anchors(words, np.array([0, len(words)]), spec)
        inside = (s.lo >= 30) & (s.hi <= 4_030)
        names.append(set(zip(s.name[inside].tolist(), (s.start[inside] - 30).tolist(), s.size[inside].tolist())))
        assert (s.size <= spec.longest).all() and (s.hi - s.lo <= spec.window).all()
    assert names[0] == names[1] and (vocabulary < 60 or len(names[0]) > 500)


def test_window_hashes_are_those_of_the_words():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, 2_000).astype(np.uint64)
    p = np.unique(rng.integers(0, 1_950, 700))
    h1, h2 = window_hashes(words, p, 50, block=100)
    seen = {}
    for i, at in enumerate(p.tolist()):
        assert seen.setdefault((int(h1[i]), int(h2[i])), words[at : at + 50].tobytes()) == words[at : at + 50].tobytes()
    assert len(seen) == len({words[at : at + 50].tobytes() for at in p.tolist()})
    assert recompress._FAR > 1 << 32


# ---- resampling


def features(text, longest):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return words, [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute_draw(rows, target, spec):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(crc32(f) % spec.buckets for f in features(text, spec.longest)[1])
    for text in target:
        t.update(crc32(f) % spec.buckets for f in features(text, spec.longest)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        words, fs = features(text, spec.longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * float(S + spec.buckets) / ((s[b] + 1) * float(T + spec.buckets)))) for b in (crc32(f) % spec.buckets for f in fs)]
        weight = sum(gain) // len(gain) if gain else 0
        if i is None:
            out.append([i, len(fs), weight, None, None, len(words)])
            continue
        h = int(hashlib.sha256(f"{spec.seed}:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    part = sorted((r for r in out if r[5] >= spec.least_words and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(part[: len(part) * spec.percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_draw_equals_brute_force(spark, longest, monkeypatch):
    monkeypatch.setattr(resample, "PIECE", 40)
    rng = np.random.default_rng(longest)
    word = [f"Wort{i}" for i in range(80)] + ["ÄÖ", "x_y", "3.14", "naïve", " a ", "日本"]
    rows = [(int(i), " ".join(rng.choice(word, int(rng.integers(0, 60))))) for i in rng.permutation(400) - 100]
    rows += [(None, "Wort1 " * 30), (1000, None), (1001, ""), (1002, "-- ,"), (7, rows[0][1]), (7, rows[0][1])]
    target = [" ".join(rng.choice(word[:20], 30)) for _ in range(40)] + ["", None]
    spec = resample.ResampleSpec(longest=longest, buckets=97, percent=30)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = [tuple(r) for r in resample.resampled(frame(spark, rows), goal, spec).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute_draw(rows, target, spec), key=key)


def test_draw_from_empty_tables(spark):
    none = frame(spark, [])
    assert resample.resampled(none, none).count() == 0
    rows = [(i, "a b c " * 10) for i in range(30)]
    got = [tuple(r) for r in resample.resampled(frame(spark, rows), none).collect()]
    assert sorted(got) == sorted(brute_draw(rows, [], resample.ResampleSpec())) or {r[0] for r in got} == set(range(30))
    assert Counter(r[4] for r in got) == Counter({None: 27, 1: 1, 2: 1, 3: 1})


def test_radix_ranks_with_ties_and_extremes(spark):
    rng = np.random.default_rng(9)
    high = 2**63 - 1
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(-3, 4, 900), rng.integers(-70_000, 70_000, 900))]
    rows += [(high, -high - 1), (-high - 1, high), (0, 0), (0, 0), (0, 0)]
    got = radix_ranks(spark.createDataFrame(rows, "a bigint, b bigint").repartition(7), [("a", True), ("b", False)]).collect()
    assert sorted(r["rank"] for r in got) == list(range(1, len(rows) + 1))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    same = radix_ranks(spark.createDataFrame([(5, 5)] * 40, "a bigint, b bigint").repartition(6), [("a", True), ("b", False)])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 41))
    assert radix_ranks(spark.createDataFrame([], "a bigint"), [("a", False)]).count() == 0


# ---- variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    k = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def brute_variants(rows, spec):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{i}:{run}".encode())
            if spec.drop_every and i is not None and h % spec.drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = [w for w in n if len(w) >= spec.least_letters and n[w] >= spec.least_count]
    near = defaultdict(list)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].append(b)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= spec.ratio * n[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("crowded", [0, 3, 2_000])
def test_variants_equal_brute_force(spark, crowded, monkeypatch):
    """Also with keys split down to the last letter."""
    monkeypatch.setattr(variants, "PIECE", 30)
    rng = np.random.default_rng(crowded)
    letters = list("abcÉß÷é")
    stems = ["".join(rng.choice(letters, int(rng.integers(3, 12)))) for _ in range(12)]
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = list(stems[min(int(rng.exponential(3)), 11)])
            for _ in range(int(rng.integers(0, 3)) if rng.random() < 0.4 else 0):
                k, what = int(rng.integers(0, len(w) + 1)), rng.integers(3)
                w[k : k + (what > 0)] = [] if what == 1 else [str(rng.choice(letters))]
            words.append("".join(w))
        rows.append((i % 290, ["-", " ", "7"][i % 3].join(words)))
    rows += [(None, "Abcabc abcabc " * 9), (1, None), (2, ""), (3, "12 ..."), (4, "É" * 3_000 + " " + "É" * 2_999), (5, "É" * 3_000), (6, "É" * 2_999)]
    spec = VariantSpec(least_letters=3, ratio=3, drop_every=5, crowded=crowded)
    got = {tuple(r) for r in spelling_variants(frame(spark, rows), spec).collect()}
    assert got == brute_variants(rows, spec)


def test_variants_of_nothing_and_roots_of_long_chains(spark):
    assert spelling_variants(frame(spark, [])).count() == 0
    assert spelling_variants(frame(spark, [(1, None), (2, "short words")])).count() == 0
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string")
    assert {r.root for r in roots(chain).collect()} == {"w40"}


def test_a_crowded_ending_makes_no_square_of_pairs(spark):
    """Thousands of words that share half of their letters: the pairs that are compared grow with the words, not their square."""
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) + "ungen" for _ in range(4_000)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n bigint")
    got = {(r.a, r.b) for r in near_pairs(df).collect()}
    by_gap = defaultdict(list)
    for w in words:
        for k in range(len(w)):
            by_gap[k, w[:k] + w[k + 1 :]].append(w)
    want = {(a, b) for ws in by_gap.values() for a in ws for b in ws if a < b}
    assert got == want and len(words) > 3_900
    assert df.where(F.length("word") != 10).count() == 0
