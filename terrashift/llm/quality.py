"""Quality by perplexity under an interpolated modified Kneser-Ney word model.

All trusted text is counted, and every trusted word and pair is in the model; only words that no trusted text has are one
unknown word. Discounts, context masses and continuation counts come from joins and aggregates over the pair counts. The
most frequent words, as many as fit in a task, are the common ones: their back-off estimates and the most frequent pairs are
looked up where the text is read. All other pairs of common words travel to the shard that holds their counts, packed per
chunk of documents, and come back as corrections, packed too, that are summed for each document. So do rare words and pairs with one, under
64-bit hashes. What two bit sets rule out does not travel. The number of shards follows the number of pairs, so a shard's
part of the model stays of one size while the corpus grows.

A document is kept when its perplexity is at most a high quantile of that of trusted documents of its language which the
model has not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashift.llm.common import crc_mod, cut
from terrashift.llm.shingles import _GOLD, mix, text_words

#: A table of trusted ids up to this many rows is broadcast (about 30 MB); a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000

_BITS = 20
_UNKNOWN, _EDGE = 0, (1 << _BITS) - 1
_PAIR = (1 << 2 * _BITS) - 1
_SPREAD, _SLOT = 636_413, 6_364_137
_BACK = pow(_SPREAD, -1, _EDGE + 1)
#: Rare words have codes outside those of common ones; with this one after it, a pair stands for the word by itself.
_RARE, _ALONE = 1 << 40, 1 << _BITS
#: Bits of a set of pairs or of rare words: 8 MB. A full one rules nothing out and changes no result.
_SET_BITS = 26
_CHUNK_WORDS, _CHUNK_DOCS = 1_000_000, 60_000
#: Trusted words whose pairs a task adds up at once.
_SHARD_WORDS = 2_000_000


@dataclass(frozen=True)
class QualitySpec:
    """Common words (at most 1,048,574) and pairs that are scored in place, quantile, pairs of the model in a shard, and the
    trusted unseen documents that a language needs for a threshold of its own. The first two and the fourth change no result."""

    words: int = 1_000_000
    frequent: int = 1_000_000
    quantile: float = 0.99
    shard_pairs: int = 500_000
    least_docs: int = 20


def _hashed(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, word hashes) of the text column ``at``."""
    for row, words in enumerate(text_words(batch.column(at))):
        yield row, words.view(np.int64)


def _counted(keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for _, words in _hashed(batch, 0):
            held.append(words)
            size += len(words)
            if size > _CHUNK_WORDS:
                yield _counted(held, ["word", "n"])
                held, size = [], 0
    yield _counted(held, ["word", "n"])


def _common(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Numbers of common words with an edge before the first and after the last word; others are unknown."""
    at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
    known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
    ids = np.full(len(words) + 2, _EDGE, np.int64)
    ids[1:-1] = np.where(known, at + 1, _UNKNOWN)
    return ids


def _codes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers of common words and the hashes of others."""
    codes = ids.copy()
    codes[1:-1] = np.where(ids[1:-1] == _UNKNOWN, words | _RARE, ids[1:-1])
    return codes


def _is_rare(code):
    return (code < 0) | (code > _EDGE)


def _pair_keys(words: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """40-bit keys of a text's word pairs, with an edge before the first and after the last word."""
    ids = _common(words, vocabulary)
    return (ids[:-1] << _BITS) | ids[1:]


def _of_common(keys: np.ndarray) -> np.ndarray:
    """Those keys that have no unknown word."""
    return keys[(keys >> _BITS != _UNKNOWN) & (keys & _EDGE != _UNKNOWN)]


def _spread(pairs: np.ndarray) -> np.ndarray:
    """Spread first words over their 20 bits, one to one: pairs of a word stay together, and shards are of like sizes."""
    return ((pairs >> _BITS) * _SPREAD & _EDGE) << _BITS | pairs & _EDGE


def _gathered(spread: np.ndarray) -> np.ndarray:
    """The keys that were spread."""
    return ((spread >> _BITS) * _BACK & _EDGE) << _BITS | spread & _EDGE


def _slot(pairs: np.ndarray) -> np.ndarray:
    """Place in the set of pairs; the product stays below 2**63, so Spark's checked arithmetic gives the same."""
    return (pairs * _SLOT & _PAIR) >> 2 * _BITS - _SET_BITS


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second bytes and so on: high bytes are mostly equal and pack well."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _from_planes(raw: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel().astype(np.int64)


def _by_shard(spread: np.ndarray, n: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted spread pairs and their counts, packed by shard: differences, and counts."""
    pack = zstandard.ZstdCompressor(level=1)
    edges = np.searchsorted((spread * shards) >> 2 * _BITS, np.arange(shards + 1))
    rows = [
        (s, pack.compress(_planes(np.diff(spread[i:j], prepend=0).astype("<u8")) + _planes(n[i:j].astype("<u4"))))
        for s, (i, j) in enumerate(zip(edges, edges[1:])) if i < j
    ]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "found"])


def _from_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Spread pairs and counts."""
    size = len(raw) // 12
    return np.cumsum(_from_planes(raw, "<u8", size, 0)), _from_planes(raw, "<u4", size, 8 * size)


def _floats(raw: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n).reshape(8, n).T).view("<f8").ravel()


def _count_pairs(vocabulary: np.ndarray, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a chunk's pairs, packed by shard."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        return _by_shard(*np.unique(_spread(_of_common(np.concatenate(held))), return_counts=True), shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words in _hashed(batch, 0):
                if len(words):
                    held.append(_pair_keys(words, vocabulary))
                    size += len(words)
                if size > _CHUNK_WORDS:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _send_pairs(shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pair, n) packed by shard, some hundred thousand rows at a time."""

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        pairs, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        spread = _spread(pairs)
        order = np.argsort(spread)
        return _by_shard(spread[order], n[order], shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size > 500_000:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return run


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """(pair, n) of one shard."""
    unpack = zstandard.ZstdDecompressor()
    raws = [unpack.decompress(f) for f in frame["found"]]
    pairs, n = (np.concatenate(x) for x in zip(*map(_from_shard, raws)))
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    return pd.DataFrame({"pair": _gathered(pairs[first]), "n": np.add.reduceat(n, first)})


def _count_rare(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a chunk's pairs that have a rare word, by the codes of both words."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(held, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(a)))
        return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, words in _hashed(batch, 0):
                if len(words):
                    codes = _codes(words, _common(words, vocabulary))
                    rare = _is_rare(codes)
                    some = rare[:-1] | rare[1:]
                    held.append(np.stack([codes[:-1][some], codes[1:][some]]))
                    size += len(words)
                if size > _CHUNK_WORDS:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    return run


def _bit_set(slots: DataFrame) -> np.ndarray:
    """Bits of the column ``slot``, eight to a byte; of a fixed size."""
    where = slots.groupBy(F.shiftright("slot", 15).alias("at")).agg(F.bitmap_construct_agg((F.col("slot") % 32768).cast("bigint")).alias("bits"))
    out = np.zeros(1 << (_SET_BITS - 3), np.uint8)
    for r in where.toArrow().to_pylist():
        out[r["at"] << 12 : (r["at"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    return out


def _in_set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


@dataclass(frozen=True)
class PairModel:
    """Arrays bounded by ``QualitySpec.words`` and ``QualitySpec.frequent``, two bit sets, and the table (shard, held, a, b, gain)
    of all other pairs and of rare words.

    ``backoff[w1] + continuation[w2]`` is the log probability of an unseen pair; ``gain`` is what a seen pair has more. A
    pair of common words is packed with its count, which gives its gain by ``gain_of``, in one of ``shards``. Others have the codes of their words; a rare
    word by itself is the pair with ``_ALONE`` and has what it changes in the estimates of the pairs before and after it.
    """

    vocabulary: np.ndarray
    backoff: np.ndarray
    continuation: np.ndarray
    pairs: np.ndarray
    gain_of: Callable[[np.ndarray, np.ndarray], np.ndarray]
    gains: np.ndarray
    has_pair: np.ndarray
    has_word: np.ndarray
    rest: DataFrame
    shards: int
    rare_shards: int


def _discounts(n: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of pairs seen once to four times; 0.5, 1, 1.5 on thin counts."""
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(v, 0.1), i + 0.9) for i, v in enumerate(d))  # type: ignore[return-value]


def _most(counts: DataFrame, most: int) -> tuple[int, int, int]:
    """The least count from which on at most ``most`` rows of (.., n) have it, the number of rows, and the sum of counts."""
    # One row for each count that occurs.
    by = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).toArrow().sort_by([("n", "descending")])
    n, c = (by[x].to_numpy().astype(np.int64) for x in ("n", "c"))
    few = n[np.cumsum(c) <= most]
    return int(few[-1]) if len(few) else int(n[0]) + 1 if len(n) else 1, int(c.sum()), int((n * c).sum())


def train(trusted: DataFrame, spec: QualitySpec = QualitySpec(), text_col: str = "text") -> PairModel:
    """Count all trusted text and estimate the model. An empty table gives a model in which every pair is equally rare."""
    text = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = cut(text.mapInArrow(_count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    least, all_words, tokens = _most(words, spec.words)
    vocabulary = np.sort(words.where(F.col("n") >= least).select("word").toArrow()["word"].to_numpy().astype(np.int64))
    some_rare = all_words > len(vocabulary)
    parts = max(12, -(-tokens // _SHARD_WORDS))
    pairs = text.mapInArrow(_count_pairs(vocabulary, parts), "shard int, found binary").groupBy("shard").applyInPandas(_add_up, "pair bigint, n bigint")
    pairs = cut(pairs, "pairs")
    first, second = F.shiftright("pair", _BITS), F.col("pair").bitwiseAND(_EDGE)
    both = pairs.select(first.alias("a"), second.alias("b"), "n")
    if some_rare:
        rare = cut(text.mapInArrow(_count_rare(vocabulary), "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")), "rare")
        both = both.unionByName(rare)
    # Counts of counts: four rows.
    seen = {int(r["n"]): r["count"] for r in both.where("n <= 4").groupBy("n").count().collect()}
    d1, d2, d3 = _discounts(seen)
    ahead = both.groupBy(F.col("a").alias("w")).agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("a"), F.count_if(F.col("n") == 2).alias("b"), F.count_if(F.col("n") > 2).alias("c")
    )
    mass = (F.lit(d1) * F.col("a") + F.lit(d2) * F.col("b") + F.lit(d3) * F.col("c")) / F.col("total")
    # Every word, and the edge, has a pair before it and one after it.
    behind = both.groupBy(F.col("b").alias("w")).agg(F.count(F.lit(1)).alias("before"))
    stats = cut(ahead.select("w", "total", mass.alias("mass")).join(behind, "w"), "stats")
    counts = stats.agg(F.sum("before"), F.count(F.lit(1)), F.count_if(F.col("before") == 1), F.count_if(F.col("before") == 2)).first()
    types, positive, once, twice = (int(v or 0) for v in counts)
    d = once / (once + 2 * twice) if once else 0.5
    size, floor = all_words + 2, d * positive / types if types else 1.0
    # At most a row for each common word and the edge.
    known = stats.where(~_is_rare(F.col("w"))).toArrow()
    at = known["w"].to_numpy()
    total, share, before = np.ones(_EDGE + 1), np.ones(_EDGE + 1), np.zeros(_EDGE + 1)
    total[at], share[at], before[at] = (known[c].to_numpy() for c in ("total", "mass", "before"))
    follow = np.maximum(before - d, 0) / max(1, types) + floor / size

    def gain_of(pair: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b = pair >> _BITS, pair & _EDGE
        low = share[a] * follow[b]
        return np.log((n - np.array([0, d1, d2, d3])[np.minimum(n, 3).astype(np.int64)]) / total[a] + low) - np.log(low)

    often = _most(pairs, spec.frequent)[0]
    often_n = pairs.where(F.col("n") >= often).toArrow().sort_by("pair")
    often_pair, often_n = (often_n[c].to_numpy().astype(np.int64) for c in ("pair", "n"))
    shards, rare_shards = max(12, -(-pairs.count() // spec.shard_pairs)), 0
    none = lambda kind: F.lit(None).cast(kind)
    # Gains follow from the counts by small arrays: counts are a few bits on their way to the shards.
    rest = pairs.where(F.col("n") < often).select("pair", "n").mapInArrow(_send_pairs(shards), "shard int, found binary")
    rest = rest.select("shard", F.col("found").alias("held"), none("bigint").alias("a"), none("bigint").alias("b"), none("double").alias("gain"))
    slot = F.shiftright((F.col("pair") * F.lit(_SLOT)).bitwiseAND(F.lit(_PAIR)), 2 * _BITS - _SET_BITS)
    has_pair, has_word = _bit_set(pairs.select(slot.alias("slot"))), np.zeros(0, np.uint8)
    if some_rare:
        after = F.greatest(F.col("before") - F.lit(d), F.lit(0.0)) / F.lit(float(types)) + F.lit(floor / size)
        left, right = stats.select(F.col("w").alias("a"), "total", "mass"), stats.select(F.col("w").alias("b"), after.alias("follow"))
        cutoff = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        low = F.col("mass") * F.col("follow")
        more = rare.join(left, "a").join(right, "b").select("a", "b", (F.log((F.col("n") - cutoff) / F.col("total") + low) - F.log(low)).alias("gain"))
        rare_words = stats.where(_is_rare(F.col("w")))
        alone = rare_words.select(F.col("w").alias("a"), F.lit(_ALONE).cast("bigint").alias("b"), (F.log("mass") + F.log(after) - F.lit(float(np.log(follow[_UNKNOWN])))).alias("gain"))
        rare_shards = max(12, -(-rare.count() // spec.shard_pairs))
        to = (F.pmod(F.col("a").bitwiseXOR(F.col("b")), F.lit(rare_shards)) + shards).cast("int")
        rest = rest.unionByName(more.unionByName(alone).select(to.alias("shard"), none("binary").alias("held"), "a", "b", "gain"))
        has_word = _bit_set(rare_words.select(F.col("w").bitwiseAND((1 << _SET_BITS) - 1).alias("slot")))
    return PairModel(
        vocabulary, np.log(share), np.log(follow), often_pair, gain_of, gain_of(often_pair, often_n), has_pair, has_word, rest, int(shards), int(rare_shards)
    )


_PACKED = "shard int, chunk bigint, docs binary, found binary"


def _scorer(model: PairModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Score in place what the bounded arrays can, and pack the other pairs of a chunk of documents by shard.

    One row for each chunk holds its documents (id, language, trust, words, log probability so far) as a small Arrow
    table; one for each chunk and shard holds sorted pairs as differences, document numbers and counts. A shard is a range
    of spread pairs, so differences are as small in many shards as in one.
    """
    vocabulary, backoff, follow, pairs, gains, shards = (
        model.vocabulary, model.backoff, model.continuation, model.pairs, model.gains, model.shards,
    )
    has_pair, has_word, rare_shards = model.has_pair, model.has_word, model.rare_shards

    def rare_of(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Codes of the rare words that trusted text may have, each by itself, and of their pairs."""
        codes = _codes(words, ids)
        rare = _is_rare(codes)
        there = ~rare
        there[rare] = _in_set(has_word, codes[rare] & ((1 << _SET_BITS) - 1))
        some = (rare[:-1] | rare[1:]) & there[:-1] & there[1:]
        own = codes[rare & there]
        return np.concatenate([np.stack([codes[:-1][some], codes[1:][some]]), np.stack([own, np.full(len(own), _ALONE)])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=1)
        docs: list[tuple] = []
        keys: list[np.ndarray] = []
        others: list[np.ndarray] = []
        size, number = 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(k) for k in keys], np.int64)
            key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            owner = np.repeat(np.arange(len(keys)), lengths)
            lp = np.bincount(owner, backoff[key >> _BITS] + follow[key & _EDGE], len(keys)) if len(key) else np.zeros(len(keys))
            at = np.minimum(np.searchsorted(pairs, key), max(0, len(pairs) - 1))
            often = pairs[at] == key if len(pairs) else np.zeros(len(key), bool)
            if often.any():
                lp += np.bincount(owner[often], gains[at[often]], len(keys))
            away = np.flatnonzero(~often & (key >> _BITS != _UNKNOWN) & (key & _EDGE != _UNKNOWN))
            away = away[_in_set(has_pair, _slot(key[away]))]
            both, n = np.unique((_spread(key[away]) << 16) | owner[away], return_counts=True)
            key, owner = both >> 16, both & 0xFFFF
            chunk = TaskContext.get().partitionId() << 24 | number
            table = pa.table(
                {
                    "doc_id": pa.array([d[0] for d in docs], pa.int64()), "lang": pa.array([d[1] for d in docs], pa.string()),
                    "part": pa.array([d[2] for d in docs], pa.int32()), "words": pa.array(lengths), "lp": pa.array(lp),
                }
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            rows = [(chunk % shards, chunk, pack.compress(sink.getvalue().to_pybytes()), None)]
            edges = np.searchsorted((key * shards) >> 2 * _BITS, np.arange(shards + 1))
            for s in range(shards):
                o = slice(edges[s], edges[s + 1])
                if edges[s] < edges[s + 1]:
                    parts = (np.diff(key[o], prepend=0).astype("<u8"), owner[o].astype("<u2"), np.minimum(n[o], 0xFFFF).astype("<u2"))
                    more = n[o] > 0xFFFF
                    extra = np.concatenate([np.flatnonzero(more), n[o][more]]).astype("<i8")  # counts that need more room
                    head = np.array([len(more), more.sum()], "<i8")
                    rows.append((s, chunk, None, pack.compress(b"".join([head.tobytes(), *map(_planes, parts), extra.tobytes()]))))
            if rare_shards:
                code, whose = np.concatenate(others, axis=1), np.repeat(np.arange(len(others)), [o.shape[1] for o in others])
                to = np.mod(code[0] ^ code[1], rare_shards)
                order = np.lexsort((code[1], code[0], to))
                edges = np.searchsorted(to[order], np.arange(rare_shards + 1))
                for s in range(rare_shards):
                    if edges[s] < edges[s + 1]:
                        o = order[edges[s] : edges[s + 1]]
                        parts = (code[0][o].astype("<i8"), code[1][o].astype("<i8"), whose[o].astype("<u2"))
                        rows.append((shards + s, chunk, None, pack.compress(b"".join(map(_planes, parts)))))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                ["shard", "chunk", "docs", "found"],
            )

        for batch in batches:
            ids, lang, part = (batch.column(i).to_pylist() for i in (0, 1, 2))
            for t, words in _hashed(batch, 3):
                docs.append((ids[t], lang[t], part[t]))
                numbers = _common(words, vocabulary)
                keys.append((numbers[:-1] << _BITS) | numbers[1:] if len(words) else np.zeros(0, np.int64))
                if rare_shards:
                    others.append(rare_of(words, numbers))
                size += len(words)
                if size > _CHUNK_WORDS or len(docs) >= _CHUNK_DOCS:
                    yield flush()
                    docs, keys, others, size, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


_FIXES = "chunk bigint, docs binary, fixes binary"
_SCORED = "doc_id bigint, lang string, part int, words bigint, lp double"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for two codes."""
    return mix(a.astype(np.uint64) * _GOLD + mix(b.astype(np.uint64)))


def _corrector(shards: int, gain_of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """One shard: the documents that were sent here as they are, and for each chunk the corrections for the pairs that the
    model has, packed: a row for a chunk and not for a document, since most documents have pairs in most shards."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        unpack = zstandard.ZstdDecompressor()
        pack = zstandard.ZstdCompressor(level=1)
        if not len(left):
            return pd.DataFrame({"chunk": [], "docs": [], "fixes": []})
        rare = int(left["shard"].iloc[0]) >= shards
        if rare:
            a, b, gains = right["a"].to_numpy(np.int64), right["b"].to_numpy(np.int64), right["gain"].to_numpy(float)
            keys = _mixed(a, b)
            order = np.argsort(keys)
            keys, a, b, gains = keys[order], a[order], b[order], gains[order]
        else:
            keys, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*(_from_shard(unpack.decompress(h)) for h in right["held"].dropna())) if len(right) else ((), ())))
            order = np.argsort(keys)
            keys, gains = keys[order], gain_of(_gathered(keys[order]), n[order])
        out = []
        for chunk, docs, found in zip(left["chunk"], left["docs"], left["found"]):
            if docs is not None:
                out.append((chunk, docs, None))
                continue
            raw = unpack.decompress(found)
            if rare:
                n = len(raw) // 18
                code_a, code_b = _from_planes(raw, "<i8", n, 0), _from_planes(raw, "<i8", n, 8 * n)
                owner, count, key = _from_planes(raw, "<u2", n, 16 * n), np.ones(n), _mixed(code_a, code_b)
            else:
                n, m = np.frombuffer(raw, "<i8", 2)
                key = np.cumsum(_from_planes(raw, "<u8", n, 16))
                owner = _from_planes(raw, "<u2", n, 16 + 8 * n)
                count = _from_planes(raw, "<u2", n, 16 + 10 * n)
                if m:
                    extra = np.frombuffer(raw, "<i8", 2 * m, 16 + 12 * n)
                    count[extra[:m]] = extra[m:]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (a[at] == code_a) & (b[at] == code_b) if rare else keys[at] == key
                who, where = np.unique(owner[hit], return_inverse=True)
                lp = np.bincount(where, count[hit] * gains[at[hit]], len(who))
                if len(who):
                    out.append((chunk, None, pack.compress(_planes(lp.astype("<f8")) + _planes(who.astype("<u2")))))
        return pd.DataFrame(out, columns=["chunk", "docs", "fixes"])

    return run


def _add_fixes(frame: pd.DataFrame) -> pd.DataFrame:
    """The documents of one chunk with all corrections."""
    unpack = zstandard.ZstdDecompressor()
    t = pa.ipc.open_stream(unpack.decompress(frame["docs"].dropna().iloc[0])).read_all()
    lp = t["lp"].to_numpy().copy()
    for raw in map(unpack.decompress, frame["fixes"].dropna()):
        n = len(raw) // 10
        lp[_from_planes(raw, "<u2", n, 8 * n)] += _floats(raw, n)
    columns = {"doc_id": pd.array(t["doc_id"].to_pylist(), "Int64"), "lang": np.array(t["lang"].to_pylist(), object)}
    return pd.DataFrame(columns | {"part": t["part"].to_numpy(), "words": t["words"].to_numpy(), "lp": lp})


def perplexities(docs: DataFrame, model: PairModel) -> DataFrame:
    """(doc_id, lang, part, words, perplexity) for each row of (doc_id, lang, part, text); words counts pairs, and a text
    without words has perplexity null."""
    packed = docs.mapInArrow(_scorer(model), _PACKED)
    both = packed.groupBy("shard").cogroup(model.rest.groupBy("shard")).applyInPandas(_corrector(model.shards, model.gain_of), _FIXES)
    one = both.groupBy("chunk").applyInPandas(_add_fixes, _SCORED)
    return one.select("doc_id", "lang", "part", "words", F.when(F.col("words") > 0, F.exp(-F.col("lp") / F.col("words"))).alias("perplexity"))


def judged(docs: DataFrame, labels: DataFrame, spec: QualitySpec = QualitySpec()) -> DataFrame:
    """One row per document: doc_id, lang, n_pairs, perplexity, threshold, kept.

    Trusted text is that of labels.quality = 1; four fifths of it (by crc32 of the id) train the model, the rest gives the
    quantiles. Conflicting labels of one document count as untrusted. A null language is the language 'und'. A language
    with too few trusted unseen documents uses the quantile over all languages; with none at all every text with words is
    kept. Texts that are null or have no word have perplexity null and are not kept. Repeated rows are judged one by one;
    rows without an id are judged like others. An empty table gives an empty result.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q = 1")
    good = cut(good.select(F.col("doc_id").alias("_id"), F.when(crc_mod(F.col("doc_id"), 5) == 0, 2).otherwise(1).alias("_part")), "trusted")
    side = F.broadcast(good) if good.count() <= BROADCAST_IDS else good
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    marked = base.join(side, base["doc_id"] == side["_id"], "left").select("doc_id", "lang", F.coalesce("_part", F.lit(0)).alias("part"), "text")
    model = train(marked.where("part = 1"), spec)
    scores = cut(perplexities(marked, model), "perplexity")
    unseen = scores.where("part = 2 and perplexity is not null")
    q = F.percentile_approx("perplexity", F.lit(spec.quantile), F.lit(10_000))
    overall = unseen.agg(q.alias("_all"))  # one row
    own = unseen.groupBy("lang").agg(q.alias("_own"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= spec.least_docs)
    out = scores.join(own, "lang", "left").join(F.broadcast(overall))
    threshold = F.coalesce("_own", "_all", F.lit(float("inf")))
    return out.select(
        "doc_id", "lang", F.col("words").alias("n_pairs"), "perplexity", threshold.alias("threshold"), F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept")
    )
