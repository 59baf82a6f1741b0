"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification on whole shingle sets, union-find.

Documents with the same shingle set are one class from the start. Class representatives meet in band buckets; a bucket
is compared as a star around its smallest member, never as all its pairs, and the verified links are united. Members of
buckets that still hold several components are compared once more by an exact prefix filter on their rarest shingles, and
only across components. So groups of thousands of copies, and passages that thousands of documents share, cost a number
of comparisons in proportion to their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut, id_and_text, sieve, with_sieve
from terrashift.llm.components import components
from terrashift.llm.shingles import band_keys, mix, superminhash, text_sets


@dataclass(frozen=True)
class NearSpec:
    """28 bands of 4 rows miss a pair at similarity 0.75 with probability 2.4e-5, one at 0.8 with 4e-7."""

    shingle: int = 5
    percent: int = 75
    bands: int = 28
    rows: int = 4


#: Items of the sets in one Arrow batch handed to Spark; a larger set is a batch of its own.
MOST_ITEMS = 1 << 20
_SIGNED = "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>"
_SETS = "doc_id bigint, items array<bigint>"


def _signer(spec: NearSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n, f1, f2, keys = [], [], [], [], []
            for doc_id, items in text_sets(batch.column(0), batch.column(1), spec.shingle):
                ids.append(doc_id)
                n.append(len(items))
                f1.append(int(items.sum(dtype=np.uint64).view(np.int64)))
                f2.append(int(mix(items).sum(dtype=np.uint64).view(np.int64)))
                keys.append(band_keys(superminhash(items, spec.bands * spec.rows), spec.bands) if len(items) else ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return run


def _listed(ids: list, sets: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "items"])


def _lister(spec: NearSpec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, held = [], [], 0
            for doc_id, items in text_sets(batch.column(0), batch.column(1), spec.shingle):
                ids.append(doc_id)
                sets.append(items.view(np.int64))
                held += len(items)
                if held > MOST_ITEMS:
                    yield _listed(ids, sets)
                    ids, sets, held = [], [], 0
            yield _listed(ids, sets)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """(a, b, shared, total) of pairs by their whole sets."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("_x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("_y"))
    shared = F.size(F.array_intersect("_x", "_y")).cast("bigint")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", shared.alias("shared"), (F.size("_x") + F.size("_y")).cast("bigint").alias("_sum"))
        .select("a", "b", "shared", (F.col("_sum") - F.col("shared")).alias("total"))
    )


#: Shingles in more open sets than this are frequent.
RARE = 64


def _open_links(open_rows: DataFrame, tried: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """Links that the stars have missed, between members of buckets that still hold several components.

    Exact prefix filter: with the shingles of every set ordered from rare to frequent, the first one that two similar sets
    share is among the first ``n - ceil(percent * n) + 1`` of both, early enough to leave room for the rest. If it is rare,
    few sets hold it and the join finds the pair. If it is frequent, the two share frequent shingles only, so what counts is
    the frequent part of each. Among sets with one frequent part the smallest is as similar to any other as a partner can
    be; across two frequent parts, if any two members are linked, each is linked to the other part's smallest set, and the
    two smallest are linked. So it is enough to compare sets with the smallest set of their own part and of other parts. A
    passage that thousands of documents share is one frequent part, and costs a number of comparisons in proportion to the
    documents.
    """
    named = open_rows.select(F.col("x").alias("doc_id"), "n", "g").distinct()
    terms = sets.join(named, "doc_id").select("doc_id", "n", "g", F.explode("items").alias("s"))
    spread = terms.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms.join(spread, "s").withColumn("often", F.col("df") > RARE)
    order = Window.partitionBy("doc_id").orderBy("df", "s")
    first = F.col("n") - F.ceil(F.col("n") * F.lit(spec.percent) / F.lit(100)) + 1
    ranked = ranked.withColumn("_i", F.row_number().over(order))
    prefix = cut(ranked.where(F.col("_i") <= first).select("s", "doc_id", "n", "g", "often", F.col("_i").alias("i")), "prefix")

    def mixed(rows: DataFrame) -> DataFrame:
        """Rows of the shingles that sets of several components hold."""
        several = rows.groupBy("s").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi")).where("_lo < _hi")
        return rows.join(several.select("s"), "s", "left_semi")

    def pairs(one: DataFrame, two: DataFrame, differ: str) -> DataFrame:
        one = one.select("s", *[F.col(c).alias(f"a_{c}") for c in one.columns if c != "s"])
        two = two.select("s", *[F.col(c).alias(f"b_{c}") for c in two.columns if c != "s"])
        size = F.lit(100) * F.least("a_n", "b_n") >= F.lit(spec.percent) * F.greatest("a_n", "b_n")
        # So many must be shared; a first shared shingle at place i leaves n - i + 1 at most.
        least = F.ceil((F.col("a_n") + F.col("b_n")) * spec.percent / F.lit(100 + spec.percent))
        room = (F.col("a_n") - F.col("a_i") + 1 >= least) & (F.col("b_n") - F.col("b_i") + 1 >= least)
        both = one.join(two, "s").where(differ).where(size).where(room)
        return both.select(F.least("a_doc_id", "b_doc_id").alias("a"), F.greatest("a_doc_id", "b_doc_id").alias("b"))

    rare = mixed(prefix.where("not often"))
    found = pairs(rare, rare, "a_doc_id < b_doc_id and a_g <> b_g")

    heavy = prefix.where("often").select("doc_id").distinct()
    part = ranked.where("often").join(heavy, "doc_id", "left_semi").groupBy("doc_id", "n", "g").agg(
        F.count(F.lit(1)).alias("_k"), F.bit_xor(F.xxhash64("s")).alias("_p1"), F.bit_xor(F.xxhash64("s", F.lit(1))).alias("_p2")
    )
    part = cut(part.select("doc_id", "n", "g", F.xxhash64("_k", "_p1", "_p2").alias("part")), "parts")
    smallest = part.groupBy("part").agg(F.min(F.struct("n", "doc_id", "g")).alias("_m"))
    own = part.join(smallest, "part").where("doc_id <> _m.doc_id and g <> _m.g")
    found = found.union(own.select(F.least("doc_id", "_m.doc_id"), F.greatest("doc_id", "_m.doc_id")))
    often = mixed(prefix.where("often").drop("often")).join(part.select("doc_id", "part"), "doc_id")
    heads = often.join(smallest.select(F.col("_m.doc_id").alias("doc_id")), "doc_id", "left_semi")
    found = found.union(pairs(often, heads, "a_doc_id <> b_doc_id and a_g <> b_g and a_part <> b_part"))

    new = found.distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti")
    return _verified(new, sets, spec).where(_linked(spec)).select("a", "b")


def _linked(spec: NearSpec) -> Column:
    return F.lit(100) * F.col("shared") >= F.lit(spec.percent) * F.col("total")


def near_groups(
    docs: DataFrame, spec: NearSpec = NearSpec(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` on their sets of word shingles (A-Z
    lower-cased, words cut at ASCII white space; a text of fewer words is one shingle). Null, empty and white-space texts
    have an empty set and are linked with nothing. component_id is the smallest id reachable; the document that bears it
    is kept. Rows with the same id count as one document with the set of any one of them, and each gets that decision.
    Rows without an id get component_id null and are kept. An empty table gives an empty result.
    """
    base = id_and_text(docs, id_col, text_col).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    signed = cut(base.mapInArrow(_signer(spec), _SIGNED), "signed")
    whole = signed.where("doc_id is not null and n_shingles > 0")
    classes = whole.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_copies"))
    reps = cut(classes.select("rep", "n_shingles"), "reps")
    firsts = whole.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = firsts.select(F.col("doc_id").alias("x"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    # dropDuplicates above keeps one row per id, so a bucket never holds a document twice.
    sized = rows.groupBy("bucket").agg(F.min(F.struct("x", "n")).alias("_c"), F.count(F.lit(1)).alias("_m")).where("_m > 1")
    members = cut(
        rows.join(sized, "bucket").select("bucket", "x", "n", F.col("_c.x").alias("c"), F.col("_c.n").alias("cn")), "buckets"
    )

    possible = F.lit(100) * F.least("n", "cn") >= F.lit(spec.percent) * F.greatest("n", "cn")
    stars = members.where(F.col("x") != F.col("c")).where(possible)
    stars = stars.select(F.col("c").alias("a"), F.col("x").alias("b")).distinct()

    # Sets of documents that share a bucket, no others; the sieve keeps the rest out before the exact semi join.
    wanted = members.select(F.col("x").alias("doc_id")).distinct()
    near = with_sieve(base, F.struct("doc_id"), sieve(wanted, F.struct("doc_id")), "_maybe").where("_maybe")
    sets = cut(
        near.select("doc_id", "text").mapInArrow(_lister(spec), _SETS).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]),
        "sets",
    )
    tried = cut(_verified(stars, sets, spec), "tried")
    links = tried.where(_linked(spec)).select("a", "b")

    # Bucket members with their component, for the buckets that still hold more than one.
    comp = components(links)
    named = members.join(comp.select(F.col("node").alias("x"), "component"), "x", "left")
    named = named.select("bucket", "x", "n", F.coalesce("component", "x").alias("g"))
    mixed = named.groupBy("bucket").agg(F.min("g").alias("_lo"), F.max("g").alias("_hi")).where("_lo < _hi")
    open_rows = cut(named.join(mixed.select("bucket"), "bucket", "left_semi").select("x", "n", "g").distinct(), "open")
    if not open_rows.isEmpty():
        more = cut(_open_links(open_rows, tried, sets, spec), "more")
        if not more.isEmpty():
            comp = components(links.union(more))

    named = classes.join(comp, classes.rep == comp.node, "left").select(
        "n_shingles", "f1", "f2", F.coalesce("component", "rep").alias("_group")
    )
    alone = signed.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = whole.join(named, ["n_shingles", "f1", "f2"]).select("doc_id", "n_shingles", F.col("_group").alias("component_id"))
    return alone.union(grouped).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
