"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is found by bisection so that the
weights reach a target entropy, or so that no source is repeated more often than allowed when every document is used at
least once. The weights become token budgets; each source then runs through as many keyed permutations of its documents
as its budget asks for, the last one in part, and is dealt into output blocks that all have the target composition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut

#: A source table up to this many rows is broadcast (a few MB); a longer one is joined by a shuffle.
BROADCAST_SOURCES = 50_000
_CELL_TOKENS = 1_000_000
_MOST_CELLS = 65_536


@dataclass(frozen=True)
class MixSpec:
    """Exactly one of ``max_repeats`` and ``entropy`` (a share of the largest possible one, 0 to 1) is the target."""

    max_repeats: float | None = 1.25
    entropy: float | None = None
    block_tokens: int = 1_000_000
    seed: int = 5
    rounds: int = 8
    floor: float = 0.0


def token_count(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(trimmed) == 0, 0).otherwise(F.size(F.split(trimmed, r"\s+"))).cast("bigint")


def source_shares(counted: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) with one row for each source that has tokens; map-side combine takes hot sources."""
    per = counted.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    total = per.agg(F.sum("tokens").alias("_all"))
    shares = per.where("tokens > 0").join(F.broadcast(total))  # one row
    return shares.select("source", "tokens", "docs", (F.col("tokens") / F.col("_all")).alias("share"))


def exponent(shares: DataFrame, spec: MixSpec) -> float:
    """Bisect the exponent in [floor, 1]: the smallest one that keeps the repetition limit, or that with the entropy.

    A lower exponent evens the weights out, raising both entropy and repetition. One job halves the interval four times
    by looking at fifteen inner points at once; what comes back are fifteen numbers, not the sources.
    """
    lo, hi = spec.floor, 1.0
    for _ in range(spec.rounds):
        points = [lo + (hi - lo) * i / 16 for i in range(1, 16)]
        raised = shares.select("share", F.posexplode(F.array(*[F.lit(p) for p in points])).alias("i", "x"))
        raised = raised.withColumn("w", F.pow("share", F.col("x")))
        per = raised.groupBy("i").agg(
            F.sum("w").alias("z"),
            F.sum(F.col("w") * F.log("w")).alias("s"),
            F.max(F.col("w") / F.col("share")).alias("most"),
            F.min(F.col("w") / F.col("share")).alias("least"),
            F.count(F.lit(1)).alias("n"),
        )
        # Entropy of normalised weights: log z - (sum w log w) / z. Repeats: most used over least used source.
        entropy = F.when(F.col("n") > 1, (F.log("z") - F.col("s") / F.col("z")) / F.log("n")).otherwise(1.0)
        rows = sorted((r.i, r.repeats, r.h) for r in per.select("i", (F.col("most") / F.col("least")).alias("repeats"), entropy.alias("h")).collect())
        if not rows:
            return 1.0
        if spec.max_repeats is not None:
            fine = [i for i, repeats, _ in rows if repeats <= spec.max_repeats]
            k = min(fine, default=15)
        else:
            k = next((i for i, _, h in rows if h <= spec.entropy), 15)
        grid = [lo, *points, hi]
        lo, hi = grid[k], grid[k + 1]
    return hi


def weights(shares: DataFrame, x: float) -> DataFrame:
    """(source, tokens, weight, epochs): normalised weights, and passes over each source for the smallest budget in which
    every document is used at least once."""
    raised = shares.withColumn("_w", F.pow("share", F.lit(x)))
    whole = raised.agg(F.sum("_w").alias("_z"), F.max(F.col("tokens") / F.col("_w")).alias("_unit"))
    return raised.join(F.broadcast(whole)).select(  # one row
        "source", "tokens",
        (F.col("_w") / F.col("_z")).alias("weight"),
        F.greatest(F.lit(1.0), F.col("_unit") * F.col("_w") / F.col("tokens")).alias("epochs"),
    )


def mix_plan(
    docs: DataFrame, spec: MixSpec = MixSpec(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row for each use of a document: doc_id, source, n_tokens, epoch, block, weight.

    Every document is used once in each whole epoch of its source and may be used in the last, partial one, which follows
    the same keyed permutation rule until the budget is met. A null source is a source of its own (returned as null).
    Null and empty texts have no tokens; they are used once, as is any document of a source without tokens. Ties of the
    permutation go by doc_id, nulls first. Repeated rows are documents of their own. An empty table gives an empty plan.
    """
    src = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    counted = docs.select(F.col(id_col).alias("doc_id"), src.alias("source"), token_count(F.col(text_col)).alias("n_tokens"))
    counted = cut(counted, "counted")
    shares = cut(source_shares(counted), "shares")
    plan = cut(weights(shares, exponent(shares, spec)), "weights")
    small = plan.count() <= BROADCAST_SOURCES
    sided = counted.join(F.broadcast(plan) if small else plan, "source", "left")
    passes = F.when(F.col("n_tokens") > 0, F.coalesce(F.ceil(F.round("epochs", 9)), F.lit(1))).otherwise(F.lit(1)).cast("int")
    used = sided.select("*", F.explode(F.sequence(F.lit(0), passes - 1)).alias("epoch"))
    u = F.xxhash64("doc_id", "source", "epoch", F.lit(spec.seed))
    cells = F.least(F.lit(_MOST_CELLS), F.greatest(F.lit(1), F.ceil(F.coalesce("tokens", F.lit(0)) / F.lit(_CELL_TOKENS))))
    # The high bits of the hash name the cell, so cells follow each other in the permutation's order.
    used = used.withColumn("_u", F.shiftrightunsigned(u, 1)).withColumn(
        "_cell", F.floor(F.shiftrightunsigned(u, 33) * cells / F.lit(2.0**31)).cast("int")
    )
    totals = used.groupBy("source", "epoch", "_cell").agg(F.sum("n_tokens").alias("_t"))
    along = Window.partitionBy("source", "epoch").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = totals.select("source", "epoch", "_cell", (F.sum("_t").over(along) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy("source", "epoch", "_cell").orderBy("_u", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = used.withColumn("_in", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(before, ["source", "epoch", "_cell"])
    done = F.col("epoch") * F.coalesce("tokens", F.lit(0)) + F.col("_before") + F.col("_in")
    kept = placed.withColumn("_done", done).where((F.col("epoch") == 0) | (F.col("_done") < F.col("epochs") * F.col("tokens")))
    per_block = F.col("weight") * F.lit(spec.block_tokens)
    return kept.select(
        "doc_id",
        F.when(F.col("source") != "n", F.expr("substring(source, 2)")).alias("source"),
        "n_tokens",
        "epoch",
        F.coalesce(F.floor(F.col("_done") / per_block), F.lit(0)).cast("bigint").alias("block"),
        "weight",
    )


def mixed(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Rows of ``docs``, all columns as they are, each as often as the plan uses it.

    Uses are counted for each id first, so that rows which share an id are repeated alike. Rows without an id stay once.
    """
    uses = mix_plan(docs, spec).where("doc_id is not null").groupBy(F.col("doc_id").alias("_mix_id"), "epoch").agg(F.count(F.lit(1)))
    uses = uses.groupBy("_mix_id").agg(F.max("epoch").alias("_mix_epoch"))
    joined = docs.join(uses, docs["doc_id"] == uses["_mix_id"], "left")
    repeat = F.explode(F.sequence(F.lit(0), F.coalesce("_mix_epoch", F.lit(0))))
    return joined.select(*[docs[c] for c in docs.columns], repeat.alias("_mix_copy")).drop("_mix_copy")
