"""Repeated passages: words that lie in a window which also starts in a document with a smaller id.

Recompression gives every text symbols that equal passages share (``recompress``). A Spark job counts in which documents
each name occurs, and a window can be repeated only where every symbol that its words determine is shared. Stretches of
such windows are the candidates; they are verified by two hashes of all words of each window, and only they are. Texts that
are copies of an earlier one as a whole share even the topmost symbol and are settled by that.

What moves between tasks: one row per symbol (a sixth of the words), rows of shared symbols, texts that hold candidates, and
two rows per candidate window. Counts are combined before the shuffle, so a passage that a third of all documents hold is
one row a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut, id_and_text, sieve, with_sieve
from terrashift.llm.recompress import ParseSpec, anchors, window_hashes
from terrashift.llm.shingles import text_words, word_chunks

_Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_KEY = "doc_id bigint, tag bigint"
_DIGESTS = f"{_KEY}, tag2 bigint, n_words bigint, whole string"
_SYMBOLS = f"{_KEY}, names array<bigint>, first array<int>, last array<int>, free_lo array<int>, free_hi array<int>"
_WINDOWS = f"{_KEY}, h1 array<bigint>, h2 array<bigint>, starts array<array<int>>"
#: Elements of the lists in one Arrow batch handed to Spark; a longer list is a batch of its own.
_MOST = 1 << 19
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_WHITE = b" \t\n\x0b\x0c\r"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a piece at a time."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and raw[end] not in _WHITE:
            end += 1
        yield raw[at:end].split()
        at = end


def _raw(texts: pa.Array) -> Iterator[bytes]:
    for b in texts.cast(pa.large_binary()):
        yield b.as_py()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words and digest of all words of each text."""
    for batch in batches:
        n, sha = [], []
        for raw in _raw(batch.column(3)):
            k, h = 0, hashlib.sha256()
            for words in _pieces(raw):
                if words:
                    h.update((b" " if k else b"") + b" ".join(words))
                    k += len(words)
            n.append(k)
            sha.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(sha)], ["doc_id", "tag", "tag2", "n_words", "whole"])


class _Rows:
    """Collects rows with lists and hands them on once they hold enough elements."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.columns, self.held = schema, [[] for _ in schema], 0

    def add(self, size: int, *values: object) -> Iterator[pa.RecordBatch]:
        for column, v in zip(self.columns, values):
            column.append(v)
        self.held += size
        if self.held > _MOST:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema)], schema=self.schema)
        self.columns, self.held = [[] for _ in self.schema], 0


def _arrow(*lists: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), *((n, pa.list_(t)) for n, t in lists)])


_ARROW_SYMBOLS = _arrow(("names", pa.int64()), *((n, pa.int32()) for n in ("first", "last", "free_lo", "free_hi")))


def _parser(spec: ParseSpec) -> _Batches:
    """Symbols of each text of at least a window, with the starts of the windows that hold neither neighbour.

    ``first`` and ``last`` bound the starts of windows from which the symbol before and the symbol after do not follow.
    ``free`` bounds those of windows that determine no symbol at all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(_ARROW_SYMBOLS)
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, words, first in word_chunks(batch.column(2), lower=False):
                s = anchors(words, first, spec)
                cuts = np.searchsorted(s.doc, np.arange(len(first)))
                sizes = np.diff(first)
                for t in np.flatnonzero(sizes >= spec.window).tolist():
                    a, b, end = int(cuts[t]), int(cuts[t + 1]), int(sizes[t]) - spec.window
                    before = np.concatenate([[0], s.lo[a:b] + 1])
                    after = np.concatenate([s.hi[a:b] - spec.window - 1, [end]])
                    free = before <= after
                    yield from rows.add(
                        b - a + 8, ids[row + t], tags[row + t], s.name[a:b].view(np.int64), before[:-1], after[1:], before[free], after[free]
                    )
        yield from rows.rest()

    return run


def _distinct(h1: np.ndarray, h2: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of one text, how often each occurs, and all starts in that order."""
    order = np.argsort(h1, kind="stable")
    h1, h2, p = h1[order], h2[order], p[order]
    new = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[: len(p)])
    return h1[new], h2[new], np.diff(np.append(new, len(p))), p


def _window_batch(ids: list, tags: list, parts: list) -> pa.RecordBatch:
    def offsets(sizes: np.ndarray) -> pa.Array:
        return pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())

    h1, h2, counts, starts = (np.concatenate(x) for x in zip(*parts))
    outer = offsets(np.array([len(x[0]) for x in parts]))
    inner = pa.ListArray.from_arrays(offsets(counts), pa.array(starts, pa.int32()))
    lists = [pa.ListArray.from_arrays(outer, x) for x in (pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), inner)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), *lists], ["doc_id", "tag", "h1", "h2", "starts"])


def _windower(spec: ParseSpec) -> _Batches:
    """Candidate windows of each text: columns doc_id, tag, text, and lists lo and hi of their starts.

    A window that a text repeats is listed once with all its starts, so a text can't make a hash frequent by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, parts, held = [], [], [], 0
        for batch in batches:
            lows, highs = batch.column(3), batch.column(4)
            for i, words in enumerate(text_words(batch.column(2), lower=False)):
                edge = np.zeros(len(words) + 2, np.int64)
                np.add.at(edge, lows[i].values.to_numpy(), 1)
                np.add.at(edge, highs[i].values.to_numpy() + 1, -1)
                p = np.flatnonzero(np.cumsum(edge)[: len(words)] > 0)
                ids.append(batch.column(0)[i].as_py())
                tags.append(batch.column(1)[i].as_py())
                parts.append(_distinct(*window_hashes(words, p, spec.window), p))
                held += len(p)
                if held > _MOST:
                    yield _window_batch(ids, tags, parts)
                    ids, tags, parts, held = [], [], [], 0
        if ids:
            yield _window_batch(ids, tags, parts)

    return run


def _joined(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans of words that windows of ``width`` words from ``starts`` on cover."""
    p = np.unique(starts)
    new = np.flatnonzero(np.concatenate([[True], np.diff(p) > width]))
    return p[new], p[np.append(new[1:] - 1, len(p) - 1)] + width


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    base = id_and_text(docs, id_col, text_col)
    return base.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tag"), F.xxhash64(F.lit(1), "text").alias("tag2"), "text")


def _of_keys(base: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Rows of ``base`` whose (doc_id, tag) is among ``keys`` (``inner``: with their columns) or not (``left_anti``).

    A bit set of fixed size spares most other texts the shuffle.
    """
    key = F.struct("doc_id", "tag")
    flagged = with_sieve(base, key, sieve(keys.select("doc_id", "tag"), key), "_maybe")
    maybe = flagged.where("_maybe").drop("_maybe")
    if how == "inner":
        return maybe.join(keys, ["doc_id", "tag"])
    return flagged.where("not _maybe").drop("_maybe").union(maybe.join(keys, ["doc_id", "tag"], "left_anti"))


def _candidates(symbols: DataFrame) -> DataFrame:
    """(doc_id, tag, lo, hi): for each text, ranges of starts of windows that may be repeated."""
    named = symbols.select("doc_id", F.explode("names").alias("name"))
    owners = named.groupBy("name").agg(F.min("doc_id").alias("_lo"), F.max("doc_id").alias("_hi"))
    shared = cut(owners.where("_lo < _hi").select("name"), "shared")
    rows = symbols.select("doc_id", "tag", F.posexplode(F.arrays_zip(F.col("names").alias("name"), "first", "last")).alias("i", "s"))
    rows = rows.select("doc_id", "tag", "i", F.col("s.name").alias("name"), F.col("s.first").alias("first"), F.col("s.last").alias("last"))
    maybe = with_sieve(rows, F.struct("name"), sieve(shared, F.struct("name")), "_maybe").where("_maybe").drop("_maybe")
    held = maybe.join(shared, "name", "left_semi")
    # Runs of neighbouring shared symbols; a row that repeats has the same symbols at the same places.
    place = F.dense_rank().over(Window.partitionBy("doc_id", "tag").orderBy("i"))
    stretch = held.withColumn("_run", F.col("i") - place).groupBy("doc_id", "tag", "_run")
    ranges = stretch.agg(F.min("first").alias("lo"), F.max("last").alias("hi")).where("lo <= hi").select("doc_id", "tag", "lo", "hi")
    free = symbols.select("doc_id", "tag", F.explode(F.arrays_zip(F.col("free_lo").alias("lo"), F.col("free_hi").alias("hi"))).alias("f"))
    every = ranges.union(free.select("doc_id", "tag", "f.lo", "f.hi"))
    return every.groupBy("doc_id", "tag").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))


def _repeats(base: DataFrame, spec: ParseSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row its digests; keys of whole copies; per text the starts of its repeated windows."""
    heads = cut(base.mapInArrow(_digest, _DIGESTS), "digests")
    known = heads.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= spec.window))
    firsts = known.groupBy("tag", "tag2").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")).where("_first < _last")
    copies = cut(known.join(firsts, ["tag", "tag2"]).where("doc_id > _first").select("doc_id", "tag").distinct(), "copies")

    lone = _of_keys(base.where("doc_id is not null").select("doc_id", "tag", "text"), copies, "left_anti")
    symbols = cut(lone.mapInArrow(_parser(spec), _SYMBOLS), "symbols")
    ranges = cut(_candidates(symbols), "candidates")
    texts = _of_keys(base.where("doc_id is not null").select("doc_id", "tag", "text"), ranges, "inner")
    windows = cut(texts.select("doc_id", "tag", "text", "lo", "hi").mapInArrow(_windower(spec), _WINDOWS), "windows")
    rows = windows.select("doc_id", "tag", F.explode(F.arrays_zip("h1", "h2", "starts")).alias("w")).select("doc_id", "tag", "w.h1", "w.h2", "w.starts")
    owners = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("_owner"), F.max("doc_id").alias("_last")).where("_owner < _last")
    hits = rows.join(owners.select("h1", "h2", "_owner"), ["h1", "h2"]).where("doc_id > _owner")
    return heads, copies, cut(hits.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("starts")).alias("starts")), "hits")


def repeated_spans(docs: DataFrame, spec: ParseSpec = ParseSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, spans): the spans of words, end exclusive, that repeat an earlier document; one row per such text.

    ``tag`` is the xxhash64 of the text, which tells texts of one id apart. Null ids are neither earlier nor later than
    others: such rows repeat nothing and nothing repeats them. Null, empty and short texts have no windows.
    """
    base = _keyed(docs, id_col, text_col)
    heads, copies, hits = _repeats(base, spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.column_stack(_joined(s.values.to_numpy(), spec.window)).tolist() for s in batch.column(2)]
            out = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], out], ["doc_id", "tag", "spans"])

    schema = f"{_KEY}, spans array<struct<start: bigint, stop: bigint>>"
    whole = heads.join(copies, ["doc_id", "tag"], "left_semi").select("doc_id", "tag", "n_words").distinct()
    whole = whole.select("doc_id", "tag", F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("stop"))).alias("spans"))
    return hits.mapInArrow(run, schema).union(whole)


def _renderer(spec: ParseSpec, texts: bool) -> _Batches:
    """What is left of each text without its repeated windows: number of words removed, digest, and the text if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, sha, left = [], [], []
            for raw, starts in zip(_raw(batch.column(2)), batch.column(3)):
                a, b = _joined(starts.values.to_numpy(), spec.window)
                k, h, out, some = 0, hashlib.sha256(), [], False
                for words in _pieces(raw):
                    # Spans that touch this piece, relative to it, from the last to the first.
                    n = len(words)
                    for i in range(int(np.searchsorted(a, k + n)) - 1, int(np.searchsorted(b, k, "right")) - 1, -1):
                        del words[max(0, int(a[i]) - k) : int(b[i]) - k]
                    k += n
                    if words:
                        h.update((b" " if some else b"") + b" ".join(words))
                        some = True
                        if texts:
                            out.append(b" ".join(words))
                removed.append(int((b - a).sum()))
                sha.append(h.hexdigest())
                left.append(b" ".join(out).decode("utf-8", "replace") if texts else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(removed, pa.int64()), pa.array(sha), pa.array(left, pa.string())], ["doc_id", "tag", "n_removed", "kept_sha256", "left"]
            )

    return run


_RENDERED = f"{_KEY}, n_removed bigint, kept_sha256 string, left string"


def without_repeats(docs: DataFrame, spec: ParseSpec = ParseSpec(), texts: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, left.

    ``left`` are the words that stay, joined by one space, for rows that lost some, and null for those that lost none.
    Null and empty texts have no words and the digest of the empty string. Rows that repeat an id are trimmed one by one
    and never against each other. A row without an id loses nothing. An empty table gives an empty result.
    """
    base = _keyed(docs, id_col, text_col)
    heads, copies, hits = _repeats(base, spec)
    texts_of = _of_keys(base.where("doc_id is not null").select("doc_id", "tag", "text"), hits, "inner")
    rendered = texts_of.select("doc_id", "tag", "text", "starts").mapInArrow(_renderer(spec, texts), _RENDERED).dropDuplicates(["doc_id", "tag"])
    emptied = copies.withColumn("_copy", F.lit(True))
    out = heads.join(rendered, ["doc_id", "tag"], "left").join(emptied, ["doc_id", "tag"], "left")
    nothing = F.sha2(F.lit(""), 256)
    columns = [
        "doc_id",
        "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
        F.when(F.col("_copy"), nothing).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    ]
    return out.select(*columns, *([F.when(F.col("_copy"), F.lit("")).otherwise(F.col("left")).alias("left")] if texts else []))
