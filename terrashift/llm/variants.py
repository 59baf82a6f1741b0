"""Spelling variants: words within one edit, found by asymmetric q-chunks, and the frequent form that each leads to.

A word contributes two disjoint chunks that cover it; a partner that is as long or one letter shorter contributes the grams
that can match a chunk, at a shift of at most one. One edit falls into one of the two chunks, so the other is preserved: the
front chunk at its place, the rear chunk moved by the difference in length. Keys that too many words share are split by the
same step on the rest of the word, the part that must hold the edit, so no group's pairs grow with its square. What meets in
a key is verified by edit distance.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import cut, id_and_text


@dataclass(frozen=True)
class VariantSpec:
    """Words have ``least_letters`` code points and ``least_count`` occurrences; a form is ``ratio`` times as frequent.

    A letter is deleted from a word of a document where the crc32 of id and word is a multiple of ``drop_every``
    (0: never). ``crowded`` is the number of pairs above which a key is split; it changes the route, not the result.
    """

    least_letters: int = 7
    least_count: int = 2
    ratio: int = 10
    drop_every: int = 31
    crowded: int = 2_000


_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_END = re.compile("[^A-Za-zÀ-ÿ]")
#: Code points whose runs are listed at once, and distinct words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 200_000


def words_of(doc_id: object, text: str, spec: VariantSpec) -> Counter[str]:
    """Occurrences of the words of one text, A-Z lowered and letters deleted; of any length."""
    runs: Counter[str] = Counter()
    low, at = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"), 0
    while at < len(low):
        gap = _END.search(low, at + PIECE)
        end = gap.start() if gap else len(low)
        runs.update(_RUN.findall(low, at, end))
        at = end
    if not spec.drop_every or doc_id is None:
        return runs
    out: Counter[str] = Counter()
    head = crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        h = crc32(run.encode(), head)
        if h % spec.drop_every == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        out[run] += n
    return out


def _counter(spec: VariantSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flushed(seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in words_of(doc_id, text.as_py(), spec).items():
                    if len(word) >= spec.least_letters:
                        seen[word] += n
                if len(seen) > HELD:
                    yield flushed(seen)
                    seen = Counter()
        yield flushed(seen)

    return run


def vocabulary(docs: DataFrame, spec: VariantSpec = VariantSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words that are long and frequent enough, counted over all texts."""
    counted = id_and_text(docs, id_col, text_col).mapInArrow(_counter(spec), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= spec.least_count)


def _slice(word: str, start: Column, stop: Column) -> Column:
    return F.substring(F.col(word), start + 1, stop - start)


def _split(rows: DataFrame, grams: bool) -> DataFrame:
    """Deal the rows of one key by one chunk more.

    A row is (key, word, n, own length, length of the chunked partner, from, to): the part of the chunked word from code
    point ``from`` up to ``to`` holds the edit, and all outside it is in the key. The part is cut into two chunks; a row
    goes on with each of them as preserved and with the other as the part that holds the edit.
    """
    lo, hi, shift = F.col("lo"), F.col("hi"), F.col("own") - F.col("size")
    mid = lo + F.floor((hi - lo) / 2).cast("int")
    front, rear = _slice("word", lo, mid), _slice("word", mid + shift, hi + shift)
    # In the partner the part ends earlier by the shift; a gram must lie within it.
    fits_front, fits_rear = mid <= hi + shift, mid + shift >= lo
    sides = F.array(
        F.struct(F.lit("f").alias("side"), front.alias("gram"), mid.alias("lo"), hi.alias("hi"), fits_front.alias("fits")),
        F.struct(F.lit("r").alias("side"), rear.alias("gram"), lo.alias("lo"), mid.alias("hi"), fits_rear.alias("fits")),
    )
    dealt = rows.select("key", "word", "n", "own", "size", F.explode(sides).alias("s"))
    if grams:
        dealt = dealt.where("s.fits")
    key = F.xxhash64("key", "s.side", "s.gram")
    return dealt.select(key.alias("key"), "word", "n", "own", "size", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))


def _met(chunks: DataFrame, grams: DataFrame) -> DataFrame:
    """Verified pairs of what shares a key; of two words of one length the lesser is ``a``."""
    a = chunks.select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("own").alias("a_own"))
    b = grams.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("own").alias("b_own"))
    both = a.join(b, "key").where("a_own > b_own or a < b")
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, spec: VariantSpec = VariantSpec()) -> DataFrame:
    """(a, a_n, b, b_n): every pair of words of ``words`` (word, n; distinct words) that differ by one edit, once."""
    base = words.select("word", "n", F.length("word").alias("own")).where("own > 0")
    chunks = base.select(F.xxhash64("own").alias("key"), "word", "n", "own", F.col("own").alias("size"), F.lit(0).alias("lo"), F.col("own").alias("hi"))
    partner = F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("size")
    grams = base.select("word", "n", "own", partner)
    grams = grams.select(F.xxhash64("size").alias("key"), "word", "n", "own", "size", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    pairs, depth = [], 0
    while True:
        chunks = cut(_split(chunks, False), f"chunks-{depth}")
        grams = cut(_split(grams, True), f"grams-{depth}")
        load = chunks.groupBy("key").agg(F.count(F.lit(1)).alias("x"), F.max(F.col("hi") - F.col("lo")).alias("rest"))
        load = load.join(grams.groupBy("key").agg(F.count(F.lit(1)).alias("y")), "key")
        # Where one letter is left, a key holds no more words than there are letters and pairs of letters.
        full = cut(load.where((F.col("x") * F.col("y") > spec.crowded) & (F.col("rest") > 1)).select("key"), f"crowded-{depth}")
        if full.isEmpty():
            pairs.append(_met(chunks, grams))
            break
        pairs.append(_met(chunks.join(full, "key", "left_anti"), grams.join(full, "key", "left_anti")))
        chunks, grams = chunks.join(full, "key", "left_semi"), grams.join(full, "key", "left_semi")
        depth += 1
    out = pairs[0]
    for p in pairs[1:]:
        out = out.union(p)
    return out.distinct()


def roots(forms: DataFrame, rounds: int = 12) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form); forms never lead in a circle.

    Pointer jumping: each round doubles the number of steps that are taken, so a chain of n steps needs log n rounds.
    """
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(rounds):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = cut(now.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = joined.drop("_moved")
        if joined.where("_moved").isEmpty():
            return now
    raise RuntimeError(f"forms still lead on after {rounds} rounds")


def spelling_variants(
    docs: DataFrame, spec: VariantSpec = VariantSpec(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are maximal runs of Latin-1 letters (and the two signs between them), A-Z lowered. ``form`` is the near word of
    largest n, of equal ones the smallest in code-point order, where that n is at least ``ratio`` times the word's; else
    null, as is ``form_n``. ``root`` is where the forms end. Null and empty texts have no words; rows that repeat an id
    count one by one; in texts without an id no letter is deleted. An empty table gives an empty result.
    """
    words = cut(vocabulary(docs, spec, id_col, text_col), "words")
    pairs = cut(near_pairs(words, spec), "near")
    both = pairs.select("a", "b", "b_n").union(pairs.select(F.col("b"), F.col("a"), F.col("a_n")))
    best = F.min(F.struct((-F.col("b_n")).alias("_less"), F.col("b").alias("form"))).alias("_best")
    found = both.groupBy(F.col("a").alias("_word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    named = words.join(found, words.word == found._word, "left")
    likely = -F.col("_best._less") >= F.col("n") * spec.ratio
    named = named.select(
        "word", F.when(likely, F.col("_best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(likely, -F.col("_best._less")).alias("form_n"),
    )
    named = cut(named, "named")
    led = roots(named.where("form is not null")).withColumnRenamed("word", "_led")
    return named.join(led, named.word == led._led, "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
