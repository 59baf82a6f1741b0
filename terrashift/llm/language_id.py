"""Language identification with a blended-spectrum string kernel.

A text is the set of its character n-grams of one to four letters, hashed to a fixed number of bits; the kernel of two
texts is the number of n-grams that both have, divided by the geometric mean of their set sizes. A bounded, documented
number of labelled texts gives the Nyström landmarks and the rows of a one-versus-rest kernel ridge regression. Scoring
is a product of the batch's presence matrix with the landmarks and the regression weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import crc_mod, cut


@dataclass(frozen=True)
class LangSpec:
    """``per_lang`` bounds the labelled texts of a language that are learned from, ``landmarks`` those used as landmarks;
    ``languages`` bounds the number of languages, most frequent first."""

    per_lang: int = 600
    landmarks: int = 96
    languages: int = 200
    bits: int = 14
    ridge: float = 1e-2
    seed: int = 23


_GRAMS = (1, 2, 3, 4)
_LETTER = r"\p{L}"


def presence(texts: list[str], bits: int) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams of letters each text has. Letters are lower-cased; runs of anything else
    count as one gap, so words are told apart but digits and marks don't weigh."""
    size = 1 << bits
    out = np.zeros((len(texts), size), np.uint8)
    flat = out.reshape(-1)
    if not texts:
        return out
    joined = "".join(t + "\n\n\n\n" for t in texts).lower()
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    # Texts are told apart by their lengths after lower-casing.
    lengths = np.array([len(t.lower()) for t in texts], np.int64) + 4
    ends = np.cumsum(lengths)
    letter = _letters(codes)
    gap = ~letter
    keep = letter | np.concatenate([[False], letter[:-1]])
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], np.minimum(ends, len(codes))])))
    row, c = row[keep], np.where(gap, np.uint32(32), codes)[keep].astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in _GRAMS:
        # h holds the hash of the n-gram that ends here; the first n - 1 places of a text belong to no n-gram.
        previous = np.concatenate([np.zeros(1, np.uint64), h[:-1]]) if n > 1 else h
        h = (previous + c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        whole = np.ones(len(c), bool)
        if n > 1:
            whole[: n - 1] = False
            whole[n - 1 :] = row[n - 1 :] == row[: len(row) - n + 1]
        slot = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)
        flat[(row * size + slot)[whole]] = 1
    return out


_TABLE = np.zeros(0, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    global _TABLE
    if not len(_TABLE):
        _TABLE = np.array([chr(i).isalpha() for i in range(0x3000)])
    known = np.minimum(codes, 0x2FFF)
    return np.where(codes < 0x3000, _TABLE[known], codes >= 0x3040)


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    weights: np.ndarray
    bits: int


def _inverse_root(k: np.ndarray) -> np.ndarray:
    """Inverse square root of a positive semidefinite matrix, small directions left out."""
    values, vectors = np.linalg.eigh(k)
    good = values > 1e-6 * values[-1]
    return vectors[:, good] / np.sqrt(values[good])


def fit(docs: DataFrame, spec: LangSpec = LangSpec(), text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LangModel:
    """Learn from at most ``per_lang`` texts of each language (smallest hashes first); whole texts are read, and 2 KB of
    bits for each of them is what reaches the driver. Rows with null text or language are left out."""
    rows = docs.where(F.col(text_col).rlike(_LETTER) & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(spec.languages).collect()
    if not sizes:
        return LangModel((), np.zeros((1 << spec.bits, 0)), spec.bits)
    # A hash below a language's share gives about half as many rows again as are wanted; the exact cut follows.
    u = F.shiftrightunsigned(F.xxhash64("id", F.lit(spec.seed)), 1) / F.lit(2.0**63)
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, 1.5 * spec.per_lang / r["count"] + 20 / r["count"])))])
    few = rows.withColumn("_u", u).where(F.col("_u") < share[F.col("lang")])
    few = few.withColumn("_i", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "id"))).where(F.col("_i") <= spec.per_lang)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = presence(frame["text"].tolist(), spec.bits)
            yield pd.DataFrame({"lang": frame["lang"], "_u": frame["_u"], "x": [np.packbits(r).tobytes() for r in x]})

    got = cut(few.select("lang", "_u", "text").mapInPandas(pack, "lang string, _u double, x binary"), "landmarks").toPandas()
    got = got.sort_values(["lang", "_u"], kind="stable")
    languages = tuple(sorted(got["lang"].unique()))
    x = np.unpackbits(np.frombuffer(b"".join(got["x"]), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
    y = (got["lang"].to_numpy()[:, None] == np.array(languages)[None, :]) * 2.0 - 1.0
    chosen = np.flatnonzero(got.groupby("lang").cumcount().to_numpy() < spec.landmarks)
    landmarks = x[chosen]
    root = _inverse_root((landmarks @ landmarks.T).astype(np.float64))
    z = (x @ landmarks.T) @ root
    # Every language weighs the same, however many texts it has.
    counts = y.clip(0).sum(0)
    w = np.array([1 / counts[languages.index(v)] for v in got["lang"]])[:, None]
    alpha = np.linalg.solve((z * w).T @ z + spec.ridge * np.eye(z.shape[1]), (z * w).T @ y)
    # Presence x landmarks x root x alpha: the last three are multiplied once, by associativity.
    return LangModel(languages, (landmarks.T @ (root @ alpha)).astype(np.float32), spec.bits)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row, over its whole text.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. The score is the softmax share of the
    chosen language; ties go to the first language by name. Repeated rows get equal answers, null ids stay null, an empty
    table gives an empty result.
    """
    languages, weights, bits = model.languages, model.weights, model.bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at : at + 256]
                names, best = ["und"] * len(part), np.zeros(len(part))
                live = np.flatnonzero(part["letters"].to_numpy()) if languages else np.zeros(0, int)
                if len(live):
                    x = presence(part["text"].iloc[live].tolist(), bits).astype(np.float32)
                    f = x @ weights / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))
                    e = np.exp(4 * (f - f.max(1, keepdims=True)))
                    pick = f.argmax(1)
                    share = e[np.arange(len(f)), pick] / e.sum(1)
                    for i, k, s in zip(live, pick, share):
                        names[i], best[i] = languages[k], s
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": names, "score": best})

    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text.rlike(_LETTER).alias("letters"))
    return base.mapInPandas(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double")


def identified(docs: DataFrame, spec: LangSpec = LangSpec()) -> DataFrame:
    """Learn from rows whose crc32(id) modulo 3 is not 1, then predict all: doc_id, held_out, lang_pred, score."""
    rest = crc_mod(F.col("doc_id"), 3)
    model = fit(docs.where(rest != 1), spec)
    return predict(docs, model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
