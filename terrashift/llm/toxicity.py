"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the words of a clause as symbols and rewrite them in turn: targets arm the insults near
them, threats need a target, negation weakens what it stands close to, and reported speech weakens what follows it. They
are composed into one machine; every symbol that it emits has a weight, and a clause's score is the weight of its insults
and threats. The insult lexicon is a set of word beginnings with weights, learned from labelled rows. A logistic curve
over a document's clause scores gives the result, so a word alone decides nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import crc_mod, cut, id_and_text

# Symbols of the grammar: plain word, insult, threat verb, target, negation, reporting verb.
PLAIN, INSULT, THREAT, TARGET, NEGATION, REPORT = "w", "I", "T", "D", "N", "R"

THREATS = "kill hurt destroy beat burn shoot töten schlagen vernichten matar golpear destruir tuer frapper détruire".split()
TARGETS = (
    "you your yours he him she her they them du dich dir ihr euch sie er tu vous toi ils elles lui "
    "tú usted ustedes vosotros ellos ellas"
).split()
NEGATIONS = "not never no nobody without nicht kein keine nie ohne ne pas jamais sans nunca sin ningún".split()
REPORTS = "said says wrote called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

_WORD = re.compile(r"[^\W_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic machine: ``step[state, symbol] = (next state, output)``; what is not listed copies its input."""

    step: dict = field(default_factory=dict)
    start: object = 0

    def read(self, state, symbol):
        return self.step.get((state, symbol), (state, symbol))

    def states(self) -> set:
        return {self.start} | {s for s, _ in self.step} | {t for t, _ in self.step.values()}


def compose(a: Transducer, b: Transducer, alphabet: str) -> Transducer:
    """The machine that feeds the output of ``a`` to ``b``; only reachable pairs of states are built."""
    step, todo, seen = {}, [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        sa, sb = todo.pop()
        for symbol in alphabet:
            na, middle = a.read(sa, symbol)
            nb, out = b.read(sb, middle)
            step[(sa, sb), symbol] = ((na, nb), out)
            if (na, nb) not in seen:
                seen.add((na, nb))
                todo.append((na, nb))
    return Transducer(step, (a.start, b.start))


def grammar() -> Transducer:
    """Targets, threats, negation and reported speech in one machine.

    Outputs: ``A`` insult aimed at a target, ``I`` insult, ``H`` threat against a target, ``i`` negated, ``q`` reported
    insult or threat; everything else is weightless.
    """
    target = Transducer({(0, TARGET): (1, TARGET), (1, INSULT): (1, "A"), (1, THREAT): (1, "H")})
    # A threat verb that is followed by its target counts when the target comes.
    threat = Transducer({(0, THREAT): (1, PLAIN), (1, TARGET): (0, "H"), (1, THREAT): (1, PLAIN)})
    near = {(n, s): (n - 1, s.lower() if s in "ITR" else s) for n in (1, 2) for s in (PLAIN, TARGET, REPORT, THREAT)}
    near |= {(n, NEGATION): (2, NEGATION) for n in (0, 1, 2)}
    near |= {(n, s): (0, "i") for n in (1, 2) for s in (INSULT, "A", "H")}
    negation = Transducer(near)
    report = Transducer({(0, REPORT): (1, REPORT), (0, "r"): (0, PLAIN)} | {(1, s): (1, "q") for s in (INSULT, "A", "H")})
    first = compose(target, threat, "wITDNR")
    return compose(compose(first, negation, "wITDNR"), report, "wITDNR")


#: Weight of an output symbol: aimed and plain insults, threats, negated and reported ones.
WEIGHTS = {"A": 1.25, "I": 1.0, "H": 1.5, "i": 0.4, "q": 0.6}
_THREAT_WEIGHT = 3.0


@dataclass(frozen=True)
class ToxicSpec:
    """``rows`` bounds the labelled rows that are learned from; word beginnings have up to ``stem`` letters."""

    rows: int = 10_000
    stem: int = 8
    least: int = 6
    stems: int = 4_096
    seed: int = 11


class ClauseScorer:
    """Finds insult and threat words with one automaton and runs the grammar over the clauses that hold them."""

    def __init__(self, stems: dict[str, float]):
        machine = grammar()
        number = {s: i for i, s in enumerate(machine.states())}
        self.start = number[machine.start]
        self.step = {(number[s], c): (number[t], out) for (s, c), (t, out) in machine.step.items()}
        self.stems = stems
        self.longest = max([0, *map(len, stems)])
        self.fixed = {w: s for ws, s in ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in ws}
        self.find = ahocorasick.Automaton()
        for word in {*stems, *THREATS}:
            self.find.add_word(word, len(word))
        if len(self.find):
            self.find.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        for n in range(min(self.longest, len(word)), 0, -1):
            if (w := self.stems.get(word[:n])) is not None:
                return INSULT, w
        kind = self.fixed.get(word, PLAIN)
        return kind, _THREAT_WEIGHT if kind == THREAT else 0.0

    def clause(self, text: str) -> float:
        """Weight of one clause."""
        state, total, held = self.start, 0.0, 0.0
        for m in _WORD.finditer(text):
            kind, weight = self.symbol(m[0])
            state, out = self.step[state, kind]
            if kind == THREAT:
                held = weight
            if (factor := WEIGHTS.get(out)) is not None:
                total += factor * (weight or held)
        return total

    def features(self, text: str) -> tuple[float, float, float]:
        """log1p of the sum and of the largest clause weight, log1p of the number of scoring clauses."""
        low = text.lower()
        hits = []
        if len(self.find):
            for end, n in self.find.iter(low):
                at = end - n + 1
                if at == 0 or not low[at - 1].isalnum():
                    hits.append(at)
        if not hits:
            return 0.0, 0.0, 0.0
        cuts = [0, *(m.end() for m in _CLAUSE.finditer(low)), len(low)]
        scores = [self.clause(low[cuts[k] : cuts[k + 1]]) for k in sorted({bisect_right(cuts, at) - 1 for at in hits})]
        scores = [s for s in scores if s > 0]
        return float(np.log1p(sum(scores))), float(np.log1p(max(scores, default=0))), float(np.log1p(len(scores)))


def _beginnings(text: str, longest: int) -> set[str]:
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(word[:n] for n in range(3, min(longest, len(word)) + 1))
        out.add(word)
    return out


def _count_stems(longest: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in (f.iloc[i : i + 256] for f in frames for i in range(0, len(f), 256)):  # few texts' stems at once
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(frame["text"], frame["toxic"]):
                seen[int(toxic)].update(_beginnings(text, longest))
            # Whether a stem has a toxic row is known only after the sum over all batches, so every count moves.
            stems = list(seen[0].keys() | seen[1].keys())
            if stems:  # Arrow can't type the columns of a batch without words
                yield pd.DataFrame({"stem": stems, "n1": [seen[1][s] for s in stems], "n0": [seen[0][s] for s in stems]})

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression with intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


@dataclass(frozen=True)
class ToxicModel:
    stems: dict[str, float]
    curve: tuple[float, ...]


def fit(docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec()) -> ToxicModel:
    """Learn the insult lexicon and the logistic curve from at most ``spec.rows`` labelled rows.

    ``labels`` has doc_id and toxic; rows without either, and toxic values other than 0 and 1, are left out, and a
    document labelled twice counts as toxic if one label says so. The rows are those with the smallest hashes. Seven in
    ten of them give the lexicon, the rest the curve, so that the curve sees stems at their real strength. With no
    labelled row of one kind the model is empty and every score is 0.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(spec.seed))
    chosen = known.orderBy(order, "doc_id").limit(spec.rows)  # the documented bound: it may be broadcast
    rows = id_and_text(docs).join(F.broadcast(chosen), "doc_id")
    rows = cut(rows.select("text", "toxic", (F.pmod(order, F.lit(10)) < 7).alias("mine")), "labelled")
    mined = rows.where("mine")
    size = {bool(r[0]): r[1] for r in mined.groupBy(F.col("toxic") == 1).count().collect()}
    pos, neg = size.get(True, 0), size.get(False, 0)
    if not pos or not neg:
        return ToxicModel({}, (-30.0, 0.0, 0.0, 0.0))
    # Counts of all stems reach the reducers once for each few hundred texts; the sample is bounded, and so is the shuffle.
    counted = mined.select("text", "toxic").mapInPandas(_count_stems(spec.stem), "stem string, n1 bigint, n0 bigint")
    counted = counted.groupBy("stem").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).where(F.col("n1") >= spec.least)
    odds = F.log((F.col("n1") + 0.5) / (pos + 1.0)) - F.log((F.col("n0") + 0.5) / (neg + 1.0))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    sure = (odds - 1.65 * spread).alias("weight")
    best = counted.select("stem", sure).where("weight > 1").orderBy(F.desc("weight"), "stem").limit(spec.stems).collect()
    scorer = ClauseScorer({r.stem: r.weight for r in best})

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            f = [scorer_for(scorer.stems).features(t) for t in frame["text"]]
            yield pd.DataFrame(f, columns=["a", "b", "c"]).assign(y=frame["toxic"].to_numpy())

    sample = rows.where("not mine").select("text", "toxic").mapInPandas(measure, "a double, b double, c double, y int").toPandas()
    curve = _logistic(sample[["a", "b", "c"]].to_numpy(), sample["y"].to_numpy(float)) if sample["y"].nunique() == 2 else np.array([-3.0, 1.5, 0, 0])
    return ToxicModel(scorer.stems, tuple(float(v) for v in curve))


_SCORERS: dict[int, ClauseScorer] = {}


def scorer_for(stems: dict[str, float]) -> ClauseScorer:
    """One automaton for each lexicon and worker."""
    key = hash(tuple(sorted(stems.items())))
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = ClauseScorer(stems)
    return _SCORERS[key]


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row, over its whole text.

    Scores lie in [0, 1]; null and empty texts get the score of a text without any match. Repeated rows get equal scores,
    a null id stays null, an empty table gives an empty result. Only the text is an input of the score.
    """
    stems, curve = model.stems, np.array(model.curve)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = scorer_for(stems)
        for frame in frames:
            x = np.array([scorer.features(t) for t in frame["text"]]).reshape(-1, 3)
            z = curve[0] + x @ curve[1:]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": 1 / (1 + np.exp(-np.clip(z, -30, 30)))})

    kind = docs.schema[id_col].dataType.simpleString()
    return id_and_text(docs, id_col, text_col).mapInPandas(run, f"doc_id {kind}, score double")


def scored(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, spec: ToxicSpec = ToxicSpec()) -> DataFrame:
    """Learn from the labelled rows whose crc32(id) modulo 5 is not 0, then score ``docs``.

    doc_id, held_out (that remainder is 0; false for a null id), score, predicted (1 from 0.5 on).
    """
    train = labels.where(crc_mod(F.col("doc_id"), 5) != 0)
    model = fit(all_docs, train, spec)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text scores below ``threshold``."""
    stems, curve = model.stems, np.array(model.curve)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        scorer = scorer_for(stems)
        x = np.array([scorer.features(t or "") for t in text]).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(curve[0] + x @ curve[1:], -30, 30))))

    return docs.where(toxic(F.col("text")) < threshold)
