"""Toxicity, languages, quality, personal data, urls and benchmark leaks: brute force, held-out accuracy, odd tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from terrashift.llm import decontaminate, language_id, pii, quality, toxicity, url_filter

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, kept string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "k") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (2, ""), (3, "   \n"), (None, "text without an id"), (5, "x" * 200_000), (6, "1234 5678")]


# --- toxicity


def test_grammar_weighs_context():
    s = toxicity.ClauseScorer({"idiot": 2.0})
    plain, aimed, negated, said = (s.features(t)[0] for t in ("the idiot left", "you are an idiot", "he is not idiot", "they said idiot"))
    assert aimed > plain > negated > 0 and plain > said > 0
    assert s.features("you. idiot")[0] == plain and s.features("nothing here") == (0, 0, 0)
    assert s.features("we will kill you")[0] > 0 and s.features("we will kill time")[0] == 0
    assert s.features("superidiotic") == (0, 0, 0)


def test_composition_equals_running_one_after_the_other():
    a = toxicity.Transducer({(0, "a"): (1, "b"), (1, "a"): (0, "a")})
    b = toxicity.Transducer({(0, "b"): (1, "x"), (1, "b"): (0, "y")})
    c = toxicity.compose(a, b, "ab")
    rng = np.random.default_rng(1)
    sa, sb, sc = a.start, b.start, c.start
    for symbol in rng.choice(list("ab"), 200):
        sa, m = a.read(sa, symbol)
        sb, out = b.read(sb, m)
        sc, both = c.read(sc, symbol)
        assert out == both


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.scored(docs, docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = Counter((r.toxic, r.predicted) for r in got)
    assert hit[1, 1] / (hit[1, 1] + hit[1, 0]) > 0.85 and hit[0, 1] <= 0.01 * (hit[0, 0] + hit[0, 1])
    assert all(0 <= r.score <= 1 for r in got)


def test_lexicon_does_not_depend_on_partitions(spark):
    """Words that stand in a few toxic rows and many clean ones keep their clean counts, however the rows are dealt."""
    rng = np.random.default_rng(2)
    words = [f"{c}{v}lm" for c in "bdfgkmnprst" for v in "aeiou"]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" idiotic" if i % 20 == 0 else "")) for i in range(2_000)]
    rows += [(i, "?!") for i in range(2_000, 2_050)]
    labels = spark.createDataFrame([(i, int(i % 20 == 0 and i < 2_000)) for i, _ in rows], "doc_id bigint, toxic int")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old, got = spark.conf.get(batch), []
    try:
        # Small files are read together again, so the batch's length is set as well.
        for parts, length in ((1, "10000"), (200, "5")):
            spark.conf.set(batch, length)
            got.append(toxicity.fit(rows_of(spark, rows).repartition(parts), labels).stems)
    finally:
        spark.conf.set(batch, old)
    assert got[0] == got[1] and "idiotic" in got[0] and not set(words) & set(got[0])


def test_toxicity_of_odd_rows(spark):
    docs = rows_of(spark, ODD)
    model = toxicity.ToxicModel({"idiot": 3.0}, (-3.0, 4.0, 0.0, 0.0))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(ODD) and len({r.score for r in got}) == 1
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.drop_toxic(rows_of(spark, [(1, "you idiot"), (2, "fine"), (3, None)]), model).count() == 2
    none = spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert toxicity.fit(docs, none).stems == {}
    assert toxicity.score(rows_of(spark, []), model).count() == 0


# --- languages


def test_languages_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identified(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert len(got) == docs.count() and right >= 0.98 * len(held)


def test_presence_equals_brute_force():
    texts = ["Hello, wörld 12 ab", "", "ÀB", "a", "!!"]
    x = language_id.presence(texts, 12)
    assert x[1].sum() == 0 and x[4].sum() == 0
    for i, t in enumerate(texts):
        cleaned = re.sub(r"[^a-zà-ÿ]+", " ", t.lower()).lstrip()
        cleaned += " " if cleaned and not cleaned.endswith(" ") else ""
        grams = {cleaned[a : a + n] for n in (1, 2, 3, 4) for a in range(len(cleaned) - n + 1)}
        assert abs(int(x[i].sum()) - len(grams)) <= 1  # hashes may meet
    assert (language_id.presence(texts[::-1], 12) == x[::-1]).all()


def test_languages_of_odd_rows(spark):
    docs = rows_of(spark, [*ODD, (9, "the cat and the dog"), (10, "der hund und die katze")])
    model = language_id.fit(docs.where("doc_id in (9, 10)").selectExpr("doc_id", "text", "if(doc_id = 9, 'en', 'de') lang"))
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(docs, model).collect()]
    assert sorted(x for i, x in got if i in (1, 2, 3, 6)) == ["und"] * 5
    assert dict(got)[9] == "en" and dict(got)[10] == "de"
    empty = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


# --- quality


def brute_perplexity(trusted: list[str], text: str, words: int) -> float:
    """Interpolated modified Kneser-Ney on word pairs, from the definition."""
    split = lambda t: re.sub(r"[A-Z]", lambda m: m[0].lower(), t).split()
    counts = Counter(w for t in trusted for w in split(t))
    vocabulary = {w for w, _ in counts.most_common(words)}
    ids = lambda t: ["<e>", *[w if w in vocabulary else "<u>" for w in split(t)], "<e>"]
    pairs = Counter(p for t in trusted if split(t) for p in zip(ids(t), ids(t)[1:]))
    of = Counter(pairs.values())
    d = quality._discounts(of)
    cut = lambda n: d[min(n, 3) - 1]
    before = Counter(b for _, b in pairs)
    once, twice = sum(v == 1 for v in before.values()), sum(v == 2 for v in before.values())
    dc = once / (once + 2 * twice) if once else 0.5
    size = len(vocabulary) + 2
    follow = lambda w: max(before[w] - dc, 0) / len(pairs) + dc * len(before) / len(pairs) / size
    total, lp = Counter(), 0.0
    mass = Counter()
    for (a, _), n in pairs.items():
        total[a] += n
        mass[a] += cut(n)
    seq = ids(text)
    for a, b in zip(seq, seq[1:]):
        n = pairs[a, b]
        lam = mass[a] / total[a] if total[a] else 1.0
        lp += np.log((max(n - cut(n), 0) / total[a] if n else 0) + lam * follow(b))
    return float(np.exp(-lp / (len(seq) - 1)))


@pytest.mark.parametrize("frequent", [10, 100_000])
def test_perplexity_equals_the_definition(spark, frequent):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    weight = 1 / np.arange(1, 61)
    draw = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    trusted = [draw(40) for _ in range(40)]
    texts = [draw(25) for _ in range(20)] + ["new words only", "W1 w2 unknown w3", trusted[0]]
    spec = quality.QualitySpec(words=10_000, frequent=frequent, shard_pairs=50)
    model = quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"), spec)
    docs = spark.createDataFrame([(i, "en", 0, t) for i, t in enumerate([*texts, ""])], "doc_id bigint, lang string, part int, text string")
    got = {r.doc_id: r for r in quality.perplexities(docs, model).collect()}
    assert got[len(texts)].perplexity is None
    for i, t in enumerate(texts):
        assert np.isclose(got[i].perplexity, brute_perplexity(trusted, t, 10_000), rtol=1e-6)


def test_no_trusted_word_is_left_out(spark):
    """Words beyond those scored in place keep their own counts, however few are scored in place."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(200)]
    weight = 1 / np.arange(1, 201)
    draw = lambda n: " ".join(rng.choice(words, n, p=weight / weight.sum()))
    trusted = [draw(40) for _ in range(40)]
    texts = [draw(25) for _ in range(20)] + ["new words only", "W1 w2 unknown w3 w199 w198 unknown", trusted[0], "w150"]
    docs = spark.createDataFrame([(i, "en", 0, t) for i, t in enumerate(texts)], "doc_id bigint, lang string, part int, text string")
    for common in (0, 7, 60):
        model = quality.train(spark.createDataFrame([(t,) for t in trusted], "text string"), quality.QualitySpec(words=common, frequent=20, shard_pairs=50))
        got = {r.doc_id: r.perplexity for r in quality.perplexities(docs, model).collect()}
        assert all(np.isclose(got[i], brute_perplexity(trusted, t, 10_000), rtol=1e-6) for i, t in enumerate(texts))


def test_quality_keeps_trusted_and_rejects_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.judged(docs, labels)
    rows = got.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert got.count() == docs.count() and np.mean(good) > 0.97


def test_quality_of_odd_rows(spark):
    docs = rows_of(spark, ODD)
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.judged(docs, labels).collect()
    assert len(got) == len(ODD)
    assert all((r.perplexity is None) == (r.n_pairs == 0) and r.kept == (r.n_pairs > 0) for r in got)
    assert quality.judged(docs.where("false"), labels).count() == 0
    assert quality.judged(docs, labels.where("false")).count() == len(ODD)


# --- personal data


def test_base_spans():
    t = "mail a.b@c-d.org, ip 10.0.0.255 not 10.0.0.256; card 4111 1111 1111 1111 not 4111 1111 1111 1112; call +49 (30) 123-4567"
    assert pii.joined(pii.base_spans(t)) == "email:5:16,ip:21:31,card:53:72,phone:103:120"
    assert pii.base_spans("x@y 1.2.3 +12") == []
    assert pii.joined(pii.base_spans("a@b.cc_x@d.ee")) == "email:0:6,email:6:13"


def test_network_gradients():
    rng = np.random.default_rng(5)
    net = pii.Network.fresh(3, 1)
    for p in net.parameters():
        p += rng.normal(0, 0.1, p.shape).astype(np.float32)
    ids, tags = rng.integers(0, 17, (7, 4)), rng.integers(0, 5, (7, 4))
    grads, loss = pii._gradients(net, ids, tags)
    for p, g in zip(net.parameters(), grads):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            old, e = p[at], np.float32(3e-3)
            p[at] = old + e
            up = pii._gradients(net, ids, tags)[1]
            p[at] = old - e
            down = pii._gradients(net, ids, tags)[1]
            p[at] = old
            assert abs((up - down) / (2 * float(e)) - g[at]) < 5e-3


def test_viterbi_and_its_bound():
    rng = np.random.default_rng(6)
    net = pii.Network.fresh(4, 2)
    net.t += rng.normal(0, 1, net.t.shape).astype(np.float32)
    net.b[0] = 2
    ids = rng.integers(0, 17, (6, 300)).astype(np.uint8)
    e = pii._emissions(net, pii._cell(net, ids, False)[0])
    assert np.allclose(pii._score(net, ids), e, atol=1e-4)
    full = pii.viterbi(e, net.t)
    assert (pii.tag_windows(net, ids) == full).all()
    k = pii._TAGS
    n = 3
    best = max(
        (net.t[k, p[0]] + net.t[p[-1], k] + sum(e[s, n, p[s]] for s in range(6)) + sum(net.t[p[s], p[s + 1]] for s in range(5)), p)
        for p in np.ndindex(*[k] * 6)
    )[1]
    assert tuple(full[:, n]) == best


def test_personal_data_of_a_table(spark):
    net = pii.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in pii.find(docs, net).collect()}
    for r in docs.collect():
        base = pii.base_spans(r.text)
        assert set(pii.joined(base).split(",")) <= set(got[r.doc_id].spans.split(",")) | {""}
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in base) for i in range(4)]
    # The network knows the kinds it was trained on, also where it must join windows.
    text = "word " * 99 + "a.person@mail.example.org " + "word " * 99
    spec = pii.PiiSpec(length=64, margin=16)
    assert any(k == 0 for _, k, _ in pii.network_spans(net, [text], spec)[0])


def test_personal_data_of_odd_rows(spark):
    docs = rows_of(spark, ODD)
    assert pii.fit(docs.where("doc_id = 2")) is None
    got = pii.find(docs, pii.Network.fresh(8, 1)).collect()
    assert len(got) == len(ODD) and all(r.n_email == 0 for r in got)
    assert pii.find(docs.where("false"), None).count() == 0


# --- urls


def test_urls_of_odd_rows(spark):
    urls = [
        None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=1", "https://a.example.com/en/", "https://a.example.com/en", "ftp://x.net/es/a/b",
        "http://net/fr/", "http://a.notnet/fr/", "x://a.com?q", "x://a.com/#f", "x://É.com/a", "x://a.org/p/://b.net/fr/",
    ]
    got = {r.url_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "url_id int, link string"), id_col="url_id", url_col="link").withColumnRenamed("page_id", "url_id").collect()}
    rules = {i: r.rule for i, r in got.items()}
    assert rules == {
        0: None, 1: None, 2: None, 3: None, 4: "www.example.com/en/", 5: "example.com/en/", 6: "com/", 7: "net/es/", 8: "net/fr/", 9: None,
        10: None, 11: "com/", 12: "com/", 13: None,
    }
    assert (got[4].host, got[4].path) == ("www.example.com", "/en/1") and (got[10].host, got[10].path) == ("a.com", "")
    assert got[12].host == "É.com" and got[13].path == "/p/://b.net/fr/" and got[0].host == got[2].path == ""
    assert {got[i].verdict for i in (7, 8, 5)} == {"block"} and {got[i].verdict for i in (4, 6, 11, 9)} == {"allow"}
    assert url_filter.judge(spark.createDataFrame([], "page_id int, url string")).count() == 0


def test_templates_spread_a_verdict(spark):
    """Pages of a host whose labelled siblings under a varying segment are blocked follow them; an allowed branch does not."""
    rows = [f"http://h.org/shop/{i}/x" for i in range(60)] + [f"http://h.org/news/{i}" for i in range(60)]
    rules = [(f"h.org", f"/shop/{i}/", "block") for i in range(40)] + [("h.org", f"/news/{i}", "allow") for i in range(10)]
    out = url_filter.judge(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string"), rules=rules)
    got = {r.page_id: r.verdict for r in out.collect()}
    assert {got[i] for i in range(60)} == {"block"} and {got[i] for i in range(60, 120)} == {"allow"}


def verdicts(spark, urls, rules):
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=rules).collect()
    return {urls[r.page_id]: (r.verdict, r.template) for r in out}


@pytest.mark.parametrize("siblings", [3, 32, 33, 3_300])
def test_verdicts_do_not_hang_on_the_number_of_siblings(spark, siblings):
    """Labelled sections are told apart from unlabelled ones however many of these there are."""
    urls = [f"http://h.net/{s}/x/{i}" for s in ("es", "fr") for i in range(max(6, siblings))]
    urls += [f"http://h.net/en/x/{i}" for i in range(max(2, siblings // 2))] + [f"http://h.net/q{chr(97 + k % 26)}{'x' * (k // 26)}/x" for k in range(siblings - 3)]
    got = verdicts(spark, urls, url_filter.RULES)
    assert {v for u, (v, _) in got.items() if "/es/" in u or "/fr/" in u} == {"block"}
    assert {v for u, (v, _) in got.items() if "/es/" not in u and "/fr/" not in u} == {"allow"}


def test_similar_siblings_merge_with_each_other(spark):
    """Branches of one block rate become one template beside an allowed one; a mixed branch joins neither."""
    urls = [f"http://h.org/{b}/p{chr(97 + i)}" for b in "abcd" for i in range(26)] + ["http://h.org/a/new", "http://h.org/c/new", "http://h.org/e/new"]
    rules = [("h.org", f"/{b}/", v) for b, v in (("a", "block"), ("b", "block"), ("c", "allow"))]
    rules += [("h.org", f"/d/p{chr(97 + i)}", "block" if i % 2 else "allow") for i in range(26)]
    got = verdicts(spark, urls, rules)
    top = {b: got[f"http://h.org/{b}/pa"][1].split("/")[1] for b in "abcd"}
    assert top["a"] == top["b"] == "*a" and top["c"] == "c" and top["d"] == "d"
    assert got["http://h.org/e/new"] == ("allow", "h.org/e/new")


def test_stages_of_the_tree_are_planned_once(spark, monkeypatch):
    """No stage plans what lies before the last one again: its plan has few exchanges, whatever the depth."""
    plans, cut = [], url_filter.cut

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return cut(df, name)

    monkeypatch.setattr(url_filter, "cut", noted)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/a{'bcd'[i % 3]}/x{'yz'[i % 2]}") for i in range(60)], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.UrlSpec(depth=3)).count() == 60
    assert max(plans) <= 12


def brute_templates(urls, rules, spec):
    """The tree walked step by step to the end of the longest path, from the definition."""
    def parts(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host, path = m.groups()
        hit = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, tuple("{n}" if re.search("[0-9]", x) else x for x in path.split("/") if x), max(hit)[1] if hit else None

    pages = [parts(u) for u in urls]
    node = [(h,) for h, _, _ in pages]
    base = np.mean([v == "block" for _, _, v in pages if v]) if any(v for *_, v in pages) else None
    for i in range(max(spec.depth, max(len(s) for _, s, _ in pages))):
        below: dict = {}
        for p, (_, s, _) in enumerate(pages):
            below.setdefault(node[p], {}).setdefault(s[i] if i < len(s) else "", []).append(p)
        for parent, kids in below.items():
            n = sum(map(len, kids.values()))
            rare = [x for x, ps in kids.items() if not any(pages[p][2] for p in ps) and len(ps) * spec.rare < n]
            named: dict = {}
            for x, ps in kids.items():
                named.setdefault("{*}" if len(rare) > 1 and x in rare else x, []).extend(ps)
            pools: dict = {}
            for x, ps in named.items():
                v = [pages[p][2] for p in ps if pages[p][2]]
                if v:
                    pools.setdefault((v.count("block") / len(v), len(v), v.count("block")), []).append(x)
            groups, last = [], None
            for (rate, k, b), xs in sorted(pools.items()):
                k, b = k * len(xs), b * len(xs)
                if last:
                    pool = (b + last[1]) / (k + last[0])
                    if abs(b / k - last[1] / last[0]) <= spec.z * np.sqrt(pool * (1 - pool) * (1 / k + 1 / last[0])):
                        groups[-1].extend(xs)
                    else:
                        groups.append(list(xs))
                else:
                    groups.append(list(xs))
                last = (k, b)
            merged = {x: "*" + min(g) for g in groups if len(g) > 1 for x in g}
            for x, ps in named.items():
                for p in ps:
                    node[p] = (*parent, merged.get(x, x))
    out = []
    for p, (h, _, v) in enumerate(pages):
        own = [pages[q][2] for q in range(len(pages)) if node[q] == node[p] and pages[q][2]]
        long = [len(s) > spec.depth for _, s, _ in pages]
        for j in range(len(node[p]), spec.depth, -1) if long[p] else ():
            own = own or [pages[q][2] for q in range(len(pages)) if long[q] and node[q][:j] == node[p][:j] and pages[q][2]]
        purity = (own.count("block") + spec.prior * base) / (len(own) + spec.prior) if base is not None else 0.0
        steps = [m for i, m in enumerate(node[p][1:]) if i < spec.depth or m]
        out.append(("/".join([h, *steps]), v or ("block" if own and purity >= spec.purity else "allow"), round(purity, 9)))
    return out


def test_templates_go_to_the_end_of_the_paths(spark):
    """Sections that differ below the second step are told apart."""
    urls = [f"http://h.org/a/b/{s}/{chr(97 + i)}x" for s in ("bad", "good") for i in range(26)] + [f"http://h.org/a/b/c/d/e/f/{s}/g" for s in ("bad", "good")]
    rules = [("h.org", f"/a/b/bad/{chr(97 + i)}x", "block") for i in range(20)] + [("h.org", f"/a/b/good/{chr(97 + i)}x", "allow") for i in range(20)]
    got = verdicts(spark, urls, rules)
    assert {v for u, (v, _) in got.items() if "/b/bad/" in u} == {"block"} and {v for u, (v, _) in got.items() if "/b/good/" in u} == {"allow"}
    assert got["http://h.org/a/b/c/d/e/f/bad/g"][1] == "h.org/a/b/c/d/e/f/bad/g"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_equal_the_definition(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", "d7", "e8"]
    urls = [f"http://h{rng.integers(2)}.org/" + "/".join(rng.choice(names, rng.integers(0, 8), p=[0.4, 0.3, 0.15, 0.1, 0.05])) for _ in range(400)]
    urls += [f"http://h0.org/a/b/{chr(97 + i % 26)}{chr(97 + i // 26)}/" + "z/" * int(rng.integers(0, 3)) for i in range(120)]
    rules = [("h0.org", "/a/b/a", "block"), ("h0.org", "/a/b/b", "allow"), ("h0.org", "/a/b/a/c", "allow"), ("h0.org", "/b/a", "block"), ("h1.org", "/a/a/a", "block"), ("h1.org", "/a/a/a/b/a", "allow")]
    spec = url_filter.UrlSpec()
    out = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), spec, rules=rules).collect()
    want = brute_templates(urls, rules, spec)
    assert [(r.template, r.verdict, round(r.purity, 9)) for r in sorted(out, key=lambda r: r.page_id)] == want


def test_one_very_long_path_takes_no_rounds(spark, monkeypatch):
    """Steps that paths share, or that one path has alone, are passed over at once."""
    rounds, one = [], url_filter._one_step
    monkeypatch.setattr(url_filter, "_one_step", lambda *a: rounds.append(1) or one(*a))
    shared = "/".join(f"s{chr(97 + i % 26)}" for i in range(500))
    urls = [f"http://h.org/{shared}/x/{shared}", f"http://h.org/{shared}/y", f"http://g.org/{shared}"]
    got = verdicts(spark, urls, [("none.org", "/", "block")])
    assert len(rounds) == 3 and all(t == u.removeprefix("http://") for u, (_, t) in got.items())


# --- benchmark leaks


def brute_leaks(docs, items, w=8):
    def template(text):
        text = re.sub(r"(?<=[^\W_,;:] |[,;:] )([A-ZÀ-Þ][^\W\d_]+)", "\x01\\1", text or "")
        words = [x for x in re.sub(r"[^\w\s\x01]|_", "", text).split()]
        return ["<num>" if x[0].isdigit() else "<name>" if x[0] == "\x01" else x.lower() for x in words]

    index: dict = {}
    size = {}
    for b, t in items:
        x = template(t)
        size[b] = max(1, len(x) - w + 1)
        for q in range(len(x) - w + 1):
            index.setdefault(tuple(x[q : q + w]), []).append((b, q))
    out = set()
    for d, t in docs:
        x, seen = template(t), Counter()
        for p in range(len(x) - w + 1):
            for b, q in index.get(tuple(x[p : p + w]), ()):
                seen[b, p - q] += 1
        out |= {(d, b) for (b, _), n in seen.items() if n >= 0.5 * size[b] or n >= 6}
    return out


def test_leaks_of_a_table(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want and got


QUESTION = "If a train of Anna goes 60 km in 3 hours and then Anna stops, how far does the train of Anna go in 9 hours?"


def test_slots_must_be_consistent(spark):
    same = QUESTION.replace("Anna", "Boris").replace("60", "75").replace("9", "12")
    mixed = QUESTION.replace("Anna", "Boris", 1)
    docs = [(1, "Before this. " + QUESTION + " And after it."), (2, same), (3, mixed), (4, "something else " * 20), (5, None), (5, None), (None, QUESTION), (1, "x")]
    items = spark.createDataFrame([(7, QUESTION, 0), (7, QUESTION, 1), (8, None, 0), (9, "too short", 0), (10, "five words are a whole", 0)], "item_id bigint, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(rows_of(spark, docs), items).collect()}
    assert set(got) == {(1, 7), (2, 7)}
    assert got[1, 7].changed_slots == 0 and got[2, 7].changed_slots > 0
    short = decontaminate.leaks(rows_of(spark, [(1, "here five words are a whole thing")]), items).collect()
    assert [(r.doc_id, r.item_id) for r in short] == [(1, 10)]
    assert decontaminate.drop_leaks(rows_of(spark, docs), items).count() == 5
    assert decontaminate.leaks(rows_of(spark, []), items).count() == 0
    assert decontaminate.leaks(rows_of(spark, docs), items.where("false")).count() == 0


def test_a_few_conflicts_do_not_hide_a_leak(spark):
    """One changed mention in a long copy, and new values that happen to be equal, are leaks; values at random are not."""
    rng = np.random.default_rng(3)
    words = [f"{c}{v}lm" for c in "bdfgkmnprst" for v in "aeiou"]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = f"{prose(60)} of Anna in 1999 {prose(70)} of Anna in 1999 {prose(60)}"
    sums = f"{prose(5)} has 3 {prose(4)} and 5 {prose(6)}"
    many = " ".join(f"{prose(3)} has 7" for _ in range(12))
    draws = iter(range(100, 112))
    docs = [
        (1, passage.replace("Anna", "Boris", 1)),
        (2, passage.replace("1999", "2001", 1)),
        (3, sums.replace("3", "4").replace("5", "4")),
        (4, re.sub("7", lambda m: str(next(draws)), many)),
        (5, many.replace("7", "8")),
        # What lies between two matched parts isn't compared, here 1999 against 2020 and Anna against Carla.
        (6, passage.replace("of Anna in 1999", "by Carla on 2020", 1)),
    ]
    items = spark.createDataFrame([(1, passage), (2, sums), (3, many)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(rows_of(spark, docs), items).collect()}
    assert got == {(1, 1), (2, 1), (3, 2), (5, 3), (6, 1)}


def test_a_look_alike_does_not_hide_the_copy_behind_it(spark):
    """The first alignment conflicts and has as many windows as the second, which is a copy."""
    mixed = QUESTION.replace("Anna", "Boris", 1).replace("60", "61")
    docs = [(1, f"{mixed} Then more. {QUESTION}"), (2, f"{mixed} Then more. {mixed}"), (3, f"{QUESTION} Then more. {mixed}")]
    items = spark.createDataFrame([(7, QUESTION)], "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(rows_of(spark, docs), items).collect()}
    assert set(got) == {1, 3} and all(r.changed_slots == 0 and r.n_windows == r.item_windows for r in got.values())
