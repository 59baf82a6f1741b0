"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

The network is trained in numpy from labelled spans of a bounded sample. Texts are cut into overlapping windows; every
window of every text is scored, and tags in an overlap come from the window in which the character lies deeper, so a span
that crosses a border is one span. Windows in which no tag sequence can beat "nothing here" are known from a bound on
emissions and transitions; the others are decoded by Viterbi.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import cut, id_and_text

# Kinds in the order of the result, and their patterns.
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end

_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, sorted by start and kind; matches that fail their test are dropped for good."""
    out: list[Span] = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in _EMAIL.finditer(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


@dataclass(frozen=True)
class PiiSpec:
    """``docs`` bounds the documents that training windows come from, ``windows`` the training windows."""

    docs: int = 3_000
    windows: int = 1_200
    hidden: int = 8
    train_length: int = 96
    length: int = 512
    margin: int = 32
    steps: int = 160
    batch: int = 192
    rate: float = 0.03
    seed: int = 17


_TAGS = len(KINDS) + 1  # tag 0 is nothing, tag k + 1 is kind k
_PAD = 17
_CLASSES = 18
_CLASS = np.full(129, 15, np.uint8)
_CLASS[128] = 14
for _chars, _c in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" ", 8), ("\t\n\r\x0b\x0c", 13)):
    _CLASS[[ord(x) for x in _chars]] = _c
for _i, _x in enumerate(".@-+"):
    _CLASS[ord(_x)] = 4 + _i
for _i, _x in enumerate("()_%"):
    _CLASS[ord(_x)] = 9 + _i
_CLASS[[ord(x) for x in ",:;/"]] = 16


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(codes, 128)]


@dataclass
class Network:
    """x: class table (2, classes, 4H); u: recurrent (2, H, 4H); o, b: emissions; t: transitions with row and column
    ``_TAGS`` for the start and the end. Gates are input, forget, output, candidate."""

    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    b: np.ndarray
    t: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.o, self.b, self.t]

    @classmethod
    def fresh(cls, hidden: int, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        x = rng.normal(0, 0.3, (2, _CLASSES, 4 * hidden)).astype(np.float32)
        x[:, :, hidden : 2 * hidden] += 1
        u = rng.normal(0, 0.3, (2, hidden, 4 * hidden)).astype(np.float32)
        o = rng.normal(0, 0.3, (2 * hidden, _TAGS)).astype(np.float32)
        return cls(x, u, o, np.zeros(_TAGS, np.float32), np.zeros((_TAGS + 1, _TAGS + 1), np.float32))


def _cell(net: Network, ids: np.ndarray, keep: bool):
    """Run both directions over ``ids`` (length, n): hidden states (length, 2, n, H), and what training needs."""
    length, n = ids.shape
    hidden = net.u.shape[1]
    # sigmoid(z) = (1 + tanh(z / 2)) / 2, so one tanh serves all four gates.
    half = np.ones(4 * hidden, np.float32)
    half[: 3 * hidden] = 0.5
    table, u = net.x * half, net.u * half
    h, c = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
    states = np.empty((length, 2, n, hidden), np.float32)
    saved = []
    z, r = np.empty((2, n, 4 * hidden), np.float32), np.empty((2, n, 4 * hidden), np.float32)
    for s in range(length):
        np.take(table[0], ids[s], axis=0, out=z[0])
        np.take(table[1], ids[length - 1 - s], axis=0, out=z[1])
        np.matmul(h, u, out=r)
        z += r
        np.tanh(z, out=z)
        z[:, :, : 3 * hidden] += 1
        z[:, :, : 3 * hidden] *= 0.5
        before = c
        c = z[:, :, hidden : 2 * hidden] * c
        c += z[:, :, :hidden] * z[:, :, 3 * hidden :]
        tc = np.tanh(c)
        past = h
        h = z[:, :, 2 * hidden : 3 * hidden] * tc
        states[s, 0], states[length - 1 - s, 1] = h[0], h[1]
        if keep:
            saved.append((z.copy(), before, tc, past))
    return states, saved


def _emissions(net: Network, states: np.ndarray) -> np.ndarray:
    """(length, n, tags)."""
    hidden = states.shape[3]
    return states[:, 0] @ net.o[:hidden] + states[:, 1] @ net.o[hidden:] + net.b


def _score(net: Network, ids: np.ndarray) -> np.ndarray:
    """Emissions (length, n, tags) without what training needs. Windows lie along the last axis, so every operation of a
    step runs over long contiguous rows."""
    length, n = ids.shape
    hidden = net.u.shape[1]
    half = np.ones(4 * hidden, np.float32)
    half[: 3 * hidden] = 0.5
    table = np.ascontiguousarray((net.x * half).transpose(0, 2, 1))
    u = np.ascontiguousarray((net.u * half).transpose(0, 2, 1))
    ahead, back = np.ascontiguousarray(net.o[:hidden].T), np.ascontiguousarray(net.o[hidden:].T)
    steps = ids.astype(np.intp)
    h, c, t = (np.zeros((2, hidden, n), np.float32) for _ in range(3))
    z, r = np.empty((2, 4 * hidden, n), np.float32), np.empty((2, 4 * hidden, n), np.float32)
    e = np.zeros((length, _TAGS, n), np.float32)
    e += net.b[:, None]
    gates = z[:, : 3 * hidden]
    i, f, o, g = (z[:, q * hidden : (q + 1) * hidden] for q in range(4))
    for s in range(length):
        np.take(table[0], steps[s], axis=1, out=z[0], mode="clip")
        np.take(table[1], steps[length - 1 - s], axis=1, out=z[1], mode="clip")
        np.matmul(u, h, out=r)
        z += r
        np.tanh(z, out=z)
        gates += 1
        gates *= 0.5
        c *= f
        np.multiply(i, g, out=t)
        c += t
        np.tanh(c, out=t)
        np.multiply(o, t, out=h)
        e[s] += ahead @ h[0]
        e[length - 1 - s] += back @ h[1]
    return e.transpose(0, 2, 1)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (np.log(np.exp(a - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def _crf_gradient(e: np.ndarray, t: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradients of the mean negative log likelihood to emissions and transitions, by forward and backward sums."""
    length, n, k = e.shape
    inner, start, end = t[:k, :k], t[k, :k], t[:k, k]
    alpha, beta = np.empty_like(e), np.empty_like(e)
    alpha[0] = e[0] + start
    for s in range(1, length):
        alpha[s] = e[s] + _lse(alpha[s - 1][:, :, None] + inner, 1)
    beta[-1] = end
    for s in range(length - 2, -1, -1):
        beta[s] = _lse(inner[None] + (e[s + 1] + beta[s + 1])[:, None, :], 2)
    z = _lse(alpha[-1] + end, 1)
    marginal = np.exp(alpha + beta - z[None, :, None])
    pair = np.exp(alpha[:-1, :, :, None] + inner + (e[1:] + beta[1:])[:, :, None, :] - z[None, :, None, None])
    one = np.eye(k, dtype=e.dtype)[tags]
    gt = np.zeros_like(t)
    gt[:k, :k] = pair.sum((0, 1)) - np.einsum("sni,snj->ij", one[:-1], one[1:])
    gt[k, :k] = (marginal[0] - one[0]).sum(0)
    gt[:k, k] = (marginal[-1] - one[-1]).sum(0)
    gold = (e * one).sum((0, 2)) + start[tags[0]] + end[tags[-1]] + inner[tags[:-1], tags[1:]].sum(0)
    return (marginal - one) / n, gt / n, float((z - gold).mean())


def _gradients(net: Network, ids: np.ndarray, tags: np.ndarray) -> tuple[list[np.ndarray], float]:
    length, n = ids.shape
    hidden = net.u.shape[1]
    states, saved = _cell(net, ids, True)
    ge, gt, loss = _crf_gradient(_emissions(net, states).astype(np.float64), net.t.astype(np.float64), tags)
    ge = ge.astype(np.float32)
    go = np.concatenate([np.einsum("snh,snk->hk", states[:, d], ge) for d in (0, 1)])
    gx, gu = np.zeros_like(net.x), np.zeros_like(net.u)
    back = np.stack([ge @ net.o[:hidden].T, (ge @ net.o[hidden:].T)[::-1]])  # by step of each direction
    dh, dc = np.zeros((2, n, hidden), np.float32), np.zeros((2, n, hidden), np.float32)
    for s in range(length - 1, -1, -1):
        z, before, tc, past = saved[s]
        i, f, o, g = (z[:, :, q * hidden : (q + 1) * hidden] for q in range(4))
        dh = dh + back[:, s]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 2)
        np.add.at(gx[0], ids[s], dz[0])
        np.add.at(gx[1], ids[length - 1 - s], dz[1])
        gu += np.matmul(past.transpose(0, 2, 1), dz)
        dh = np.matmul(dz, net.u.transpose(0, 2, 1))
        dc = dc * f
    return [gx, gu, go, ge.sum((0, 1)), gt.astype(np.float32)], loss


def train(ids: np.ndarray, tags: np.ndarray, spec: PiiSpec = PiiSpec()) -> Network:
    """Adam on windows (n, length) of character classes and tags."""
    net = Network.fresh(spec.hidden, spec.seed)
    rng = np.random.default_rng(spec.seed)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    for step in range(1, spec.steps + 1):
        some = rng.choice(len(ids), min(spec.batch, len(ids)), replace=False)
        grads, _ = _gradients(net, ids[some].T, tags[some].T)
        scale = min(1.0, 5.0 / (np.sqrt(sum(float((g * g).sum()) for g in grads)) + 1e-9))
        rate = spec.rate * (1 - 0.9 * step / spec.steps)
        for p, g, m, v in zip(net.parameters(), grads, first, second):
            g = g * scale
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def viterbi(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best tags (length, n)."""
    length, n, k = e.shape
    score = e[0] + t[k, :k]
    came = np.empty((length, n, k), np.int8)
    for s in range(1, length):
        way = score[:, :, None] + t[:k, :k]
        came[s] = way.argmax(1)
        score = way.max(1) + e[s]
    tags = np.empty((length, n), np.int64)
    tags[-1] = (score + t[:k, k]).argmax(1)
    for s in range(length - 1, 0, -1):
        tags[s - 1] = came[s][np.arange(n), tags[s]]
    return tags


def tag_windows(net: Network, ids: np.ndarray) -> np.ndarray:
    """Tags (length, n) of windows of classes. A window is decoded only if some tag could beat nothing: any path gains at
    most ``advantage + 2 * g`` at each of its tagged places, with g the most that a transition is better than none."""
    e = _score(net, ids)
    e[ids == _PAD] = [0.0] + [-1e4] * (_TAGS - 1)
    k = _TAGS
    g = max(0.0, float((net.t[:k, :k] - net.t[0, 0]).max()), float((net.t[k, :k] - net.t[k, 0]).max()), float((net.t[:k, k] - net.t[0, k]).max()))
    open_ = np.flatnonzero((e[:, :, 1:].max(2) - e[:, :, 0]).max(0) + 2 * g > 0)
    tags = np.zeros(ids.shape, np.int8)
    if len(open_):
        tags[:, open_] = viterbi(e[:, open_], net.t)
    return tags


def _plausible(text: str, kind: int) -> bool:
    """An exact check of a span that only the network has found."""
    digits = sum("0" <= c <= "9" for c in text)
    letters = any(c.isalpha() for c in text)
    if kind == 0:
        at = text.find("@")
        return 0 < at < len(text) - 3 and "." in text[at + 2 : -1] and not any(c.isspace() for c in text)
    if letters or "@" in text:
        return False
    return (digits >= 4 and text.count(".") == 3) if kind == 1 else 12 <= digits <= 19 if kind == 2 else 7 <= digits <= 15


def network_spans(net: Network, texts: list[str], spec: PiiSpec, rows: int = 1536) -> list[list[Span]]:
    """Spans of every text by the network alone, over all of its windows."""
    stride = spec.length - 2 * spec.margin
    codes = [classes(t) for t in texts]
    tags = [np.zeros(len(c), np.int8) for c in codes]
    places = [(i, a) for i, c in enumerate(codes) for a in range(0, max(1, len(c) - 2 * spec.margin), stride) if len(c)]
    places.sort(key=lambda p: len(codes[p[0]]) - p[1])  # windows of like length share a batch
    for at in range(0, len(places), rows):
        some = places[at : at + rows]
        longest = min(spec.length, max(len(codes[i]) - a for i, a in some))
        ids = np.full((longest, len(some)), _PAD, np.uint8)
        for j, (i, a) in enumerate(some):
            piece = codes[i][a : a + spec.length]
            ids[: len(piece), j] = piece
        got = tag_windows(net, ids)
        for j in np.flatnonzero(got.any(0)):
            i, a = some[j]
            lo = 0 if a == 0 else spec.margin
            hi = spec.length - spec.margin if a + spec.length < len(codes[i]) else len(codes[i]) - a
            tags[i][a + lo : a + hi] = got[lo:hi, j]
    out = []
    for t in tags:
        if not t.any():
            out.append([])
            continue
        edges = np.flatnonzero(np.diff(t, prepend=0, append=0))
        out.append([(int(a), int(t[a]) - 1, int(b)) for a, b in zip(edges, edges[1:]) if t[a]])
    return out


def added(text: str, base: list[Span], more: list[Span]) -> list[Span]:
    """Network spans, trimmed of outer spaces and dots, that hold a plausible value and touch no base span."""
    out = []
    for a, k, b in more:
        while a < b and text[a] in " .,;:(\n":
            a += 1
        while b > a and text[b - 1] in " .,;:)\n":
            b -= 1
        if all(b <= x or a >= y for x, _, y in base) and _plausible(text[a:b], k):
            out.append((a, k, b))
    return out


def fit(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> Network | None:
    """Train on windows around the labelled spans of at most ``spec.docs`` documents that have digits or an at sign, with
    as many windows from elsewhere in them; None if there is no labelled span at all."""
    order = F.xxhash64("doc_id", "text", F.lit(spec.seed))
    base = id_and_text(docs)
    likely = base.where(F.col("text").rlike("[0-9]|@")).select("doc_id", order.alias("_o"))
    ids = likely.orderBy("_o").limit(spec.docs).select("_o")  # the documented bound: it may be broadcast
    rows = base.withColumn("_o", order).join(F.broadcast(ids.distinct()), "_o").select("_o", "text")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        half = spec.train_length // 2
        for frame in frames:
            out = []
            for o, text in zip(frame["_o"], frame["text"]):
                spans = base_spans(text)
                tags = np.zeros(len(text), np.int8)
                for a, k, b in spans:
                    tags[a:b] = k + 1
                code = classes(text)
                rng = np.random.default_rng(abs(int(o)))
                centres = [(1, a + int(rng.integers(-half // 2, half // 2 + b - a))) for a, _, b in spans]
                centres += [(0, int(c)) for c in rng.integers(0, max(1, len(text)), max(1, len(spans)))]
                for i, (hit, c) in enumerate(centres):
                    a = min(max(0, c - half), max(0, len(text) - spec.train_length))
                    x, y = np.full(spec.train_length, _PAD, np.uint8), np.zeros(spec.train_length, np.uint8)
                    x[: len(code[a : a + spec.train_length])] = code[a : a + spec.train_length]
                    y[: len(tags[a : a + spec.train_length])] = tags[a : a + spec.train_length]
                    out.append((hit, int(hashlib.md5(f"{o}|{i}".encode()).hexdigest()[:15], 16), x.tobytes(), y.tobytes()))
            yield pd.DataFrame(out, columns=["hit", "o", "x", "y"])

    found = cut(rows.mapInPandas(windows, "hit int, o bigint, x binary, y binary"), "windows")
    half = [found.where(F.col("hit") == h).orderBy("o").limit(spec.windows // 2).collect() for h in (1, 0)]
    if not half[0]:
        return None
    some = half[0] + half[1]
    ids_, tags = (np.array([np.frombuffer(r[c], np.uint8) for r in some]) for c in ("x", "y"))
    return train(ids_, tags.astype(np.int64), spec)


_RESULT = "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def find(docs: DataFrame, net: Network | None, spec: PiiSpec = PiiSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the fixed patterns' spans, spans of
    all (``kind:start:end`` in code points), n_added.

    Null and empty texts have no spans. Spans of the network that touch a base span are dropped, base spans never. Repeated
    rows get equal answers, null ids stay null, an empty table gives an empty result.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for at in range(0, len(frame), 1024):
                texts = frame["text"].iloc[at : at + 1024].tolist()
                more = network_spans(net, texts, spec) if net else [[]] * len(texts)
                for text, extra in zip(texts, more):
                    base = base_spans(text)
                    new = added(text, base, extra) if extra else []
                    n = [sum(k == q for _, k, _ in base) for q in range(4)]
                    out.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + new), len(new)))
            names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            result = pd.DataFrame(out, columns=names)
            result.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield result

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInPandas(run, f"doc_id {kind}, {_RESULT}")


def personal_data(docs: DataFrame, spec: PiiSpec = PiiSpec()) -> DataFrame:
    """Train on a bounded sample of ``docs``, then find spans in all of it."""
    return find(docs, fit(docs, spec), spec)
