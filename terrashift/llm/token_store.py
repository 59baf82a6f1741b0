"""Token ids in wavelet matrices: one compressed file per shard, with access, counting and lookup by rank and select.

Documents go to shards by ranges of doc_id. A shard's ids, end id after each document, are stored as sixteen bit planes,
most significant bit first. After each plane the sequence is dealt stably into the ids whose bit is 0 and those whose bit
is 1, so one walk down the planes finds an id's rank or a position's id. Each plane carries the number of its zeros and
counts of ones at every 512 bits; a row of the shard's Parquet file holds them with the documents' ids and lengths. Spark
writes the files by its commit protocol, so a lost executor leaves no half-written shard.
"""

from __future__ import annotations

import codecs
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain
from operator import attrgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import id_and_text
from terrashift.session import scratch_path

PLANES = 16
_BLOCK = 512
#: New words that the tokenizer gets in one call.
_JOINED = 4096
#: Characters that the tokenizer gets in one call, if they are of several texts.
_AT_ONCE = 1 << 18
#: Bytes of text that are split into words at once, if they are of several texts.
_PIECE = 2 << 20
#: Words whose ids are copied at once.
_GATHERED = 1 << 15
#: Marks that may end a word; behind letters they are one piece of the pre-tokenizer.
_MARKS = '.,;:!?"#$%&()*+/=@_~-'


@dataclass(frozen=True)
class TokenSpec:
    """A shard is a range of ids with ``shard_chars`` characters on average; ranges are cut by rows, so those of long
    documents are larger, and all rows of one id are one shard."""

    tokenizer: str
    pattern: str
    end_id: int = 0
    shard_chars: int = 8_000_000
    memo_words: int = 120_000


class WaveletMatrix:
    """Succinct sequence of 16-bit ids."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        zeros, planes, ranks = np.zeros(PLANES, np.int64), [], []
        now = ids.astype(np.uint16)
        for p in range(PLANES):
            bit = (now & np.uint16(1 << (PLANES - 1 - p))) != 0
            packed = np.packbits(bit)
            planes.append(packed)
            counts = np.bitwise_count(packed)
            full = np.zeros(-(-len(packed) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
            full[: len(packed)] = counts
            ranks.append(np.concatenate([[0], np.cumsum(full.reshape(-1, _BLOCK // 8).sum(1, dtype=np.int64))]).astype(np.uint32))
            left = np.compress(~bit, now)
            zeros[p] = len(left)
            now = np.concatenate([left, np.compress(bit, now)])
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, p: int, i: int) -> int:
        """Ones of plane p before position i."""
        block = i // _BLOCK
        start = block * _BLOCK // 8
        bits = np.bitwise_count(self.planes[p][start : i // 8]).sum()
        rest = i % 8
        tail = int(self.planes[p][i // 8] >> (8 - rest)).bit_count() if rest else 0
        return int(self.ranks[p][block]) + int(bits) + tail

    def access(self, i: int) -> int:
        """Id at position i."""
        value = 0
        for p in range(PLANES):
            bit = int(self.planes[p][i // 8] >> (7 - i % 8)) & 1
            ones = self._ones(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` occurs before position i."""
        lo = 0
        for p in range(PLANES):
            a, b = self._ones(p, lo), self._ones(p, i)
            if token >> (PLANES - 1 - p) & 1:
                lo, i = int(self.zeros[p]) + a, int(self.zeros[p]) + b
            else:
                lo, i = lo - a, i - b
        return i - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, p: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of plane p."""
        at = np.arange(len(self.ranks[p]), dtype=np.int64)
        before = self.ranks[p] if bit else np.minimum(at * _BLOCK, self.n) - self.ranks[p].astype(np.int64)
        block = int(np.searchsorted(before, k, "right")) - 1
        part = np.unpackbits(self.planes[p][block * _BLOCK // 8 : (block + 1) * _BLOCK // 8])[: self.n - block * _BLOCK]
        return block * _BLOCK + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``; -1 if there are fewer."""
        if k >= self.count(token):
            return -1
        lo = 0
        for p in range(PLANES):
            ones = self._ones(p, lo)
            lo = int(self.zeros[p]) + ones if token >> (PLANES - 1 - p) & 1 else lo - ones
        i = lo + k
        for p in reversed(range(PLANES)):
            bit = token >> (PLANES - 1 - p) & 1
            i = self._select_bit(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All ids in order, undoing the planes from the last to the first."""
        now = np.zeros(self.n, np.uint16)
        for p in reversed(range(PLANES)):
            z = int(self.zeros[p])
            now[z:] |= np.uint16(1 << (PLANES - 1 - p))
            bit = np.unpackbits(self.planes[p], count=self.n).view(bool)
            back = np.empty_like(now)
            back[np.flatnonzero(~bit)], back[np.flatnonzero(bit)] = now[:z], now[z:]
            now = back
        return now

    def dump(self) -> dict:
        pack = zstandard.ZstdCompressor(level=1)
        return {
            "n": self.n,
            "zeros": self.zeros.tolist(),
            "planes": [pack.compress(x.tobytes()) for x in self.planes],
            "ranks": [pack.compress(np.diff(x).astype(np.uint16).tobytes()) for x in self.ranks],
        }

    @classmethod
    def load(cls, row: dict) -> WaveletMatrix:
        unpack = zstandard.ZstdDecompressor()
        planes = [np.frombuffer(unpack.decompress(x), np.uint8) for x in row["planes"]]
        ranks = [np.concatenate([[0], np.cumsum(np.frombuffer(unpack.decompress(x), np.uint16), dtype=np.uint32)]).astype(np.uint32) for x in row["ranks"]]
        return cls(int(row["n"]), np.array(row["zeros"], np.int64), planes, ranks)


_STORE = (
    "shard int, n bigint, doc_ids array<bigint>, lengths array<bigint>, zeros array<bigint>, "
    "planes array<binary>, ranks array<binary>"
)


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of entries that have ``most`` in all, or of one larger entry."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield at, stop
        at = stop


def _gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The ids of the entries ``code`` one after another; positions are held for some ten thousand entries at a time."""
    out, at = np.empty(int(size[code].sum()), ids.dtype), 0
    for lo in range(0, len(code), _GATHERED):
        part = code[lo : lo + _GATHERED]
        n = size[part]
        ends = np.cumsum(n)
        out[at : at + ends[-1]] = ids[np.arange(ends[-1]) + np.repeat(start[part] - (ends - n), n)]
        at += int(ends[-1])
    return out


def _joined(words: pa.Array, before: str = " ") -> str:
    """Words with a space, or what is given, before each."""
    if words.nbytes > 1 << 30:
        return before + before.join(words.to_pylist())
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
    return before + pc.binary_join(one, before)[0].as_py()


def _within(likely: pa.Array, words: pa.Array, pattern: str) -> pa.Array:
    """Which words match the pattern, where only the likely ones can."""
    return pc.replace_with_mask(likely, likely, pc.match_substring_regex(words.filter(likely), pattern))


class Encoder:
    """The public tokenizer with a memo of words.

    The pre-tokenizer of byte-level BPE always cuts before a space that a visible character follows, so a text is the
    concatenation of its first word and of all others with their space, and each distinct word is encoded once. It also
    cuts between letters and the marks behind them and around a line break between visible characters, so such a word is a
    plain one and a tail, or two of them, the second with the break before it. A new word of letters is one piece of the
    pre-tokenizer and goes straight to the library's byte-pair encoding, its bytes shown by characters. Other new words go
    to the library many at a time, joined by spaces. As every token stands for a known number of bytes, the ids of words are
    told apart by adding up bytes. Texts with other white space after a space and texts with special tokens are left to the
    library as they are.

    Words and ids stay in Arrow and numpy arrays throughout: a word of the memo takes some 25 bytes, as an entry of a
    dictionary it took about 200.
    """

    _odd = r" ([\s\p{Z}\x0b\x{85}\x1c-\x1f]|$)|<\|"
    _letters = r"^\n?\p{L}+$"
    _broken = rf"^\p{{L}}+[{_MARKS}]*\n\p{{L}}+[{_MARKS}]*$"

    def __init__(self, spec: TokenSpec):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.spec = spec
        self.tokenizer = Tokenizer.from_file(spec.tokenizer)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << PLANES:
            raise ValueError(f"ids have {PLANES} bits; the vocabulary of {spec.tokenizer} is larger")
        #: At most ``memo_words`` words and the ids of each with a space or its line break before it: first ``again`` words that were met again
        #: after they came here, then the others, the lately used first in both. Most words are met once, and would
        #: otherwise drive out those that are met now and then.
        self.memo, self.again = pa.array([], pa.large_string()), 0
        self.memo_ids, self.memo_size = np.zeros(0, np.uint16), np.zeros(0, np.int64)
        self.end = np.array([spec.end_id], np.uint16)
        # Byte-level tokens show a byte by one character: itself if it is visible, else the next one from 256 on.
        shown = sorted(ByteLevel.alphabet())
        hidden = iter([c for c in shown if ord(c) > 255])
        self.shown = "".join(chr(b) if chr(b) in shown else next(hidden) for b in range(256))
        self.line = self.tokenizer.token_to_id(self.shown[10])
        self.bytes_of = np.zeros(1 << PLANES, np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes_of[i] = len(token)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids by the library, which takes far more memory for a text than its ids do: a limited number of characters at once."""
        out: list[np.ndarray] = []
        for a, b in _runs(np.fromiter(map(len, texts), np.int64, len(texts)), _AT_ONCE):
            out += [np.array(e.ids, np.uint16) for e in self.tokenizer.encode_batch_fast(texts[a:b], add_special_tokens=False)]
        return out

    def _spelled(self, words: pa.Array, line: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of letters, each with a space or, if ``line``, its own line break before it, and their numbers."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        spell, number = self.tokenizer.model.tokenize, attrgetter("id")
        for at in range(0, len(words), _JOINED):
            text = _joined(words[at : at + _JOINED], "" if line else "\n ")
            shown = codecs.charmap_decode(text.encode(), "strict", self.shown)[0].split(self.shown[10])[1:]
            # Tokens are read and dropped at once: thousands of them held together take twice the time.
            raw = np.fromiter(map(number, chain.from_iterable(map(spell, shown))), np.uint16)
            stops = np.cumsum(np.fromiter(map(len, shown), np.int64, len(shown)))
            size = np.diff(np.searchsorted(np.cumsum(self.bytes_of[raw]), stops) + 1, prepend=0)
            ids.append(np.insert(raw, np.cumsum(size) - size, self.line) if line else raw)
            sizes.append(size + line)
        return np.concatenate(ids), np.concatenate(sizes)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space before it, and their numbers, by one call for some thousand words."""
        ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            raw = self._whole([_joined(part)])[0]
            last = np.cumsum(self.bytes_of[raw])
            stops = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            ends = np.searchsorted(last, stops) + 1
            if ends[-1] == len(last) and (last[ends - 1] == stops).all():
                ids.append(raw)
                sizes.append(np.diff(ends, prepend=0))
            else:
                # A token spans two words, as a special one may: word by word then.
                each = self._whole([" " + w for w in part.to_pylist()])
                ids += each
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space or its line break before it, and their numbers, from the memo or by the library."""
        found = pc.index_in(words, self.memo)
        at = np.flatnonzero(pc.is_null(found).to_numpy(zero_copy_only=False))
        new = words.take(pa.array(at))
        letters = pc.match_substring_regex(new, self._letters).to_numpy(zero_copy_only=False)
        line = pc.starts_with(new, "\n").to_numpy(zero_copy_only=False)
        # Words of letters with a space before them, those with a line break, and the others.
        groups = [np.flatnonzero(x) for x in (letters & ~line, letters & line, ~letters)]
        order = np.concatenate(groups)
        new = new.take(pa.array(order))
        a, b = np.cumsum([len(x) for x in groups[:2]])
        (ids_a, size_a), (ids_b, size_b), (ids_c, size_c) = self._spelled(new[:a], False), self._spelled(new[a:b], True), self._new(new[b:])
        ids, size = np.concatenate([self.memo_ids, ids_a, ids_b, ids_c]), np.concatenate([self.memo_size, size_a, size_b, size_c])
        start, old = np.cumsum(size) - size, len(self.memo)
        code = found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code[at[order]] = old + np.arange(len(new))
        rest = np.ones(old, bool)
        rest[code[code < old]] = False
        rest = np.flatnonzero(rest)
        again, most = np.concatenate([code[code < old], rest[rest < self.again]]), self.spec.memo_words * 3 // 4
        keep = np.concatenate([again[:most], old + np.arange(len(new)), again[most:], rest[rest >= self.again]])[: self.spec.memo_words]
        self.again = min(len(again), most)
        self.memo = pa.concat_arrays([self.memo, new]).take(pa.array(keep))
        self.memo_ids, self.memo_size = _gather(ids, start, size, keep), size[keep]
        return _gather(ids, start, size, code), size[code]

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, each with a space before it, and their numbers."""
        broken = _within(pc.match_substring(words, "\n"), words, self._broken)
        lines = words.filter(broken)
        firsts, seconds = pc.replace_substring_regex(lines, r"\n.*", ""), pc.replace_substring_regex(lines, r"^[^\n]*", "")
        parts = pa.concat_arrays([pc.replace_with_mask(words, broken, firsts), seconds])
        short = pc.utf8_rtrim(parts, _MARKS)
        ended = _within(pc.less(pc.binary_length(short), pc.binary_length(parts)), short, self._letters)
        plain = pc.if_else(ended, short, parts).dictionary_encode()
        tail = pc.replace_substring_regex(parts.filter(ended), r"^\n?\p{L}+", "").dictionary_encode()
        ids, size = self._plain(plain.dictionary)
        tails = self._whole(tail.dictionary.to_pylist())
        # Two entries for each part, its plain one and its tail; the last entry is the tail of the others.
        size = np.concatenate([size, np.fromiter(map(len, tails), np.int64, len(tails)), [0]])
        pairs = np.full((len(parts), 2), len(size) - 1, np.int32)
        pairs[:, 0] = plain.indices.to_numpy()
        pairs[ended.to_numpy(zero_copy_only=False), 1] = len(plain.dictionary) + tail.indices.to_numpy()
        # Four entries for each word: those of its first part and, if it has a line break, those of its second.
        code = np.full((len(words), 4), len(size) - 1, np.int32)
        code[:, :2] = pairs[: len(words)]
        code[broken.to_numpy(zero_copy_only=False), 2:] = pairs[len(words) :]
        return _gather(np.concatenate([ids, *tails]), np.cumsum(size) - size, size, code.ravel()), sum(size[x] for x in code.T)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, each text followed by the end id, and the number of ids of each text."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False))
        if len(odd):
            whole = dict(zip(odd.tolist(), self._whole(texts.take(pa.array(odd)).to_pylist())))
            texts = pc.if_else(pc.match_substring_regex(texts, self._odd), pa.scalar("", pa.large_string()), texts)
        words = pc.split_pattern(texts, " ")
        flat = words.flatten().dictionary_encode()
        code = flat.indices.to_numpy().copy()
        bounds = words.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        ids, size = self._ids(flat.dictionary)
        # The first word of a text has no space before it; an entry of its own stands for it.
        heads = self._whole(flat.dictionary.take(pa.array(code[bounds[:-1]])).to_pylist())
        code[bounds[:-1]] = len(size) + np.arange(len(heads))
        size = np.concatenate([size, np.fromiter(map(len, heads), np.int64, len(heads)), [1]])
        code = np.insert(code, bounds[1:], len(size) - 1)
        tokens = _gather(np.concatenate([ids, *heads, self.end]), np.cumsum(size) - size, size, code)
        counts = np.add.reduceat(size[code], bounds[:-1] + np.arange(len(heads)))
        if len(odd):
            pieces = np.split(tokens, np.cumsum(counts)[:-1])
            for i, raw in whole.items():
                pieces[i] = np.concatenate([raw, self.end])
            tokens, counts = np.concatenate(pieces), np.array([len(x) for x in pieces], np.int64)
        return tokens, counts


_ENCODERS: dict[TokenSpec, Encoder] = {}


def _encoder(spec: TokenSpec) -> Encoder:
    """One encoder and memo for each worker."""
    if spec not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        _ENCODERS[spec] = Encoder(spec)
    return _ENCODERS[spec]


def _shard_writer(spec: TokenSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode the sorted rows of one partition and give its wavelet matrix as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoder(spec)
        ids, lengths, parts = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            octets = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for a, b in _runs(octets, _PIECE):
                tokens, counts = encoder.encode(batch.column(1)[a:b])
                parts.append(tokens)
                lengths += counts.tolist()
        if ids:
            tokens = np.concatenate(parts)
            parts.clear()
            pa.default_memory_pool().release_unused()
            row = {"shard": TaskContext.get().partitionId(), "doc_ids": ids, "lengths": lengths} | WaveletMatrix.build(tokens).dump()
            yield pa.RecordBatch.from_pylist([row], _arrow_schema())

    return run


def _arrow_schema() -> pa.Schema:
    longs, blobs = pa.list_(pa.int64()), pa.list_(pa.binary())
    return pa.schema(
        [("shard", pa.int32()), ("n", pa.int64()), ("doc_ids", longs), ("lengths", longs), ("zeros", longs), ("planes", blobs), ("ranks", blobs)]
    )


def write_tokens(docs: DataFrame, path: str, spec: TokenSpec, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token files of a document table to the folder ``path``, in ascending doc_id order.

    Null and empty texts are documents of the end id alone. Rows that repeat an id follow each other, ordered by text. Rows
    without an id come first. A long text stays whole; it only makes its shard longer. An empty table writes no shard.
    """
    base = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chars = base.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-chars // spec.shard_chars))
    # The partition number is the shard number: ranges of doc_id rise with it.
    ranged = base.repartitionByRange(int(shards), "doc_id").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(_shard_writer(spec), _STORE).write.option("compression", "none").parquet(path)


def _shard_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decode shards: one row per document."""
    for batch in batches:
        for i in range(len(batch)):
            # Shard by shard: a batch holds all shards of a split.
            row = batch.slice(i, 1).to_pylist()[0]
            tokens = WaveletMatrix.load(row).decode().astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            starts = np.cumsum(lengths) - lengths
            view = memoryview(tokens.view(np.uint8))
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["shard"]] * len(lengths), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                ["shard", "doc_id", "_at", "n_tokens", "ids_crc32"],
            )


def read_tokens(stored: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start, n_tokens, ids_crc32, all from the files' contents."""
    docs = stored.mapInArrow(_shard_reader, "shard int, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint")
    along = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per shard: some tens of MB of text each, so a petabyte is a table of tens of millions of small rows.
    first = stored.select("shard", "n").withColumn("_first", F.sum("n").over(along) - F.col("n")).drop("n")
    return docs.join(first, "shard").select("doc_id", (F.col("_first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(stored: DataFrame, token: int) -> DataFrame:
    """(doc_id, n): occurrences of a token in each document that has it, by rank and select on the compressed planes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                m = WaveletMatrix.load(row)
                where = [m.select(token, k) for k in range(m.count(token))]
                ends = np.cumsum(np.asarray(row["lengths"]))
                owner, n = np.unique(np.searchsorted(ends, where, "right"), return_counts=True)
                yield pd.DataFrame({"doc_id": np.asarray(row["doc_ids"])[owner.astype(int)], "n": n})

    return stored.mapInPandas(run, "doc_id bigint, n bigint")


def token_digest(docs: DataFrame, spec: TokenSpec) -> DataFrame:
    """Write the token files to the shared folder, read them back, and report each document from them."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_tokens(docs, path, spec)
    return read_tokens(spark.read.schema(_STORE).parquet(path))
