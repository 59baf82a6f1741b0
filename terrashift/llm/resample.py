"""Importance resampling towards a target text collection.

Runs of words are hashed into buckets; what a bucket is worth is the log ratio of its smoothed shares in the target and in
all documents. Bucket counts are dense arrays, summed over the tasks, so the model has one size whatever the corpus; a
document's weight is a gather from the array of gains. Weights plus Gumbel noise, which hangs on the id alone, make the
draw without replacement a matter of taking the highest scores, and ranks come from the radix sort.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import cut, id_and_text
from terrashift.llm.radix import radix_ranks


@dataclass(frozen=True)
class ResampleSpec:
    """Features are the runs of 1 to ``longest`` words; of the documents with ``least_words`` words, ``percent`` are drawn."""

    longest: int = 1
    buckets: int = 10_000
    seed: int = 2024
    percent: int = 10
    least_words: int = 20


#: Letters and digits of ASCII (upper case is lowered first) and all bytes of other characters.
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Bytes of a text whose words are listed at once.
PIECE = 1 << 20


def _buckets(raw: bytes, spec: ResampleSpec) -> Iterator[tuple[int, np.ndarray]]:
    """Piece by piece of one text: its number of words and the buckets of the features that end in it."""
    low, at, tail = raw.lower(), 0, []
    while at < len(low):
        gap = _GAP.search(low, at + PIECE)
        end = gap.start() if gap else len(low)
        words = _WORD.findall(low, at, end)
        n, codes = len(words), list(map(crc32, words))
        if spec.longest > 1:
            words = tail + words
            for k in range(2, spec.longest + 1):
                codes += [crc32(b" ".join(words[i - k : i])) for i in range(max(k, len(tail) + 1), len(words) + 1)]
            tail = words[-(spec.longest - 1) :]
        yield n, np.array(codes, np.int64) % spec.buckets
        at = end


def _raw(texts: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of every text."""
    for b in texts.cast(pa.large_binary()):
        yield b.as_py()


_Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _counter(spec: ResampleSpec) -> _Batches:
    """One row for each bucket that a task's texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(spec.buckets, np.int64), [], 0
        for batch in batches:
            for raw in _raw(batch.column(0)):
                for _, at in _buckets(raw, spec):
                    held.append(at)
                    size += len(at)
                    if size > PIECE:
                        total += np.bincount(np.concatenate(held), minlength=spec.buckets)
                        held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=spec.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, spec: ResampleSpec, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket. The driver gets ``spec.buckets`` sums, whatever the number of texts."""
    col = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = np.zeros(spec.buckets, np.int64)
    for r in col.mapInArrow(_counter(spec), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all, k = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weigher(gain: np.ndarray, spec: ResampleSpec) -> _Batches:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for raw in _raw(batch.column(1)):
                n = m = total = 0
                for k, at in _buckets(raw, spec):
                    n, m, total = n + k, m + len(at), total + int(gain[at].sum())
                words.append(n)
                features.append(m)
                weights.append(total // m if m else 0)
            longs = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel deviate, rounded down, that hangs on the id and the seed alone; null for a null id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resampled(
    docs: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank (null for what is not drawn), all bigint.

    ``target`` has a column text. Null and empty texts have no features and weight 0. Rows that repeat an id take part one
    by one; rows that are alike in score and id follow each other. A row without an id has no score and is not drawn. With
    an empty table the result is empty; with an empty target the gains are those of no target counts.
    """
    base = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    gain = gains(bucket_counts(base, spec), bucket_counts(target, spec))
    weighed = base.mapInArrow(_weigher(gain, spec), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), spec.seed))
    scored = cut(scored, "weighed")
    takes_part = F.col("score").isNotNull() & (F.col("n_words") >= spec.least_words)
    parts = scored.where(takes_part)
    draw = parts.count() * spec.percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = radix_ranks(parts.select(*columns), [("score", True), ("doc_id", False)], "_rank")
    drawn = F.when(F.col("_rank") <= draw, F.col("_rank")).alias("rank")
    rest = scored.where(~F.coalesce(takes_part, F.lit(False))).select(*columns, F.lit(None).cast("bigint").alias("rank"))
    return ranked.select(*columns, drawn).union(rest)
