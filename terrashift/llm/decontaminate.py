"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units and names become typed placeholders, so that a question with other figures has the same template. Windows
of eight template words are joined by hash. A matched window fixes how a benchmark item lies on a document; in the matched
windows of that alignment the placeholders' values should map one to one, and a match with a larger share of conflicts is
taken for chance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashift.llm.common import cut

#: A window table up to this many rows is broadcast (about 40 MB); a longer one is joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000

UNITS = (
    "km m cm mm kg g mg l ml s ms min h hours minutes seconds days years miles feet inches dollars euros percent "
    "meters metres grams liters litres stunden jahre años heures ans"
).split()

# A capitalised word that follows a word or a comma, and so doesn't open a sentence.
_NAME = r"(?<=[\p{L}\p{N},;:] )(\p{Lu}[\p{L}]+)"
_MARK = "\u0001"


@dataclass(frozen=True)
class LeakSpec:
    """An item leaks into a document with ``share`` of its windows, or with ``run`` windows (of ``window`` words).

    Of the slots, ``split`` may have another word than their value has elsewhere, and ``clash`` in all may conflict, be it so
    or by sharing a word with another value; new values that happen to be equal are no sign of chance. Conflicts in up to
    ``split`` of the matched windows are no reason to reject when the other windows suffice by themselves.
    """

    window: int = 8
    shortest: int = 5
    share: float = 0.5
    run: int = 6
    literal: int = 3
    split: float = 0.1
    clash: float = 0.5


def raw_words(text: Column) -> Column:
    """Words with names marked; punctuation is dropped inside and around them, so 3.5 stays one word."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, _MARK + "$1")
    bare = F.trim(F.regexp_replace(F.regexp_replace(marked, rf"[^\p{{L}}\p{{N}}\s{_MARK}]+", ""), r"\s+", " "))
    return F.when(F.length(bare) > 0, F.split(bare, " ")).otherwise(F.array().cast("array<string>"))


def template(words: str) -> Column:
    """Template words of the array column ``words``."""
    units = ", ".join(f"'{u}'" for u in UNITS)
    return F.expr(
        f"transform({words}, (w, i) -> CASE WHEN w >= '0' AND w < ':' THEN '<num>' WHEN startswith(w, '{_MARK}') THEN '<name>' "
        f"WHEN i > 0 AND {words}[i - 1] >= '0' AND {words}[i - 1] < ':' AND lower(w) IN ({units}) THEN '<unit>' ELSE lower(w) END)"
    )


def _windows(df: DataFrame, width: int) -> DataFrame:
    """(carried columns, at, h): hash of each window of ``width`` words of ``t``."""
    hashes = F.expr(
        f"CASE WHEN size(t) >= {width} THEN transform(sequence(1, size(t) - {width - 1}), "
        f"i -> xxhash64({width}, array_join(slice(t, i, {width}), ' '))) END"
    )
    return df.select(*[c for c in df.columns if c not in ("t", "raw")], F.posexplode(hashes).alias("at", "h"))


def _enough(n: Column, spec: LeakSpec) -> Column:
    """Whether ``n`` windows of an item are a leak."""
    return (n >= F.lit(spec.share) * F.col("item_windows")) | (n >= spec.run)


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    spec: LeakSpec = LeakSpec(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, item_windows, n_slots, changed_slots,
    contaminated (true).

    n_windows counts distinct item windows found along the best alignment whose slots hold; slots are placeholders of the
    item in those windows, changed ones have another value in the document. Items of fewer than ``window`` template words match as a whole;
    items under ``shortest`` words, null and empty ones match nothing, nor do windows with fewer than ``literal`` words
    beside placeholders. Null and empty documents leak nothing. Repeated rows of one document or item count once. Rows
    without an id are left out. Empty tables give an empty result.
    """
    items = benchmark.where("item_id is not null").select("item_id", raw_words(F.col("text")).alias("raw"))
    items = items.select("item_id", "raw", template("raw").alias("t")).dropDuplicates(["item_id"])
    items = cut(items.where(F.size("t") >= spec.shortest), "items")
    short = [r[0] for r in items.where(F.size("t") < spec.window).select(F.size("t")).distinct().collect()]  # a few widths
    widths = sorted({*short, spec.window})
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), raw_words(F.col(text_col)).alias("raw"))
    shaped = base.select("doc_id", template("raw").alias("t"))

    literal = F.expr("size(filter(slice(t, at + 1, _w), w -> NOT startswith(w, '<')))")
    parts = []
    for w in widths:
        own = items.where(F.size("t") == w) if w < spec.window else items.where(F.size("t") >= w)
        cutout = _windows(own.select("item_id", "t", F.col("t").alias("keep")), w)
        cutout = cutout.withColumn("t", F.col("keep")).withColumn("_w", F.lit(w)).where(literal >= spec.literal)
        parts.append(cutout.select("item_id", F.col("at").alias("q"), "h", F.greatest(F.size("t") - w + 1, F.lit(1)).alias("item_windows")))
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.union(p)
    wanted = cut(wanted, "windows")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_WINDOWS else wanted

    found = None
    for w in widths:
        hits = _windows(shaped, w).join(side, "h").select("doc_id", "item_id", "item_windows", "q", (F.col("at") - F.col("q")).alias("shift"))
        found = hits if found is None else found.union(hits)
    aligned = found.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("q").alias("_qs"), F.first("item_windows").alias("item_windows")
    )
    aligned = aligned.withColumn("n_windows", F.size("_qs").cast("bigint"))
    # Every alignment that suffices is checked; an early look-alike must not hide the copy behind it.
    aligned = cut(aligned.where(_enough(F.col("n_windows"), spec)), "aligned")

    slots = items.select("item_id", F.posexplode(F.arrays_zip("raw", "t")).alias("q", "w")).where("w.t in ('<num>', '<name>', '<unit>')")
    inside = F.expr(f"exists(_qs, x -> q between x and x + {spec.window - 1})")
    need = aligned.join(slots, "item_id").where(inside)
    need = cut(
        need.select("doc_id", "item_id", "shift", "q", (F.col("q") + F.col("shift")).cast("int").alias("at"), F.lower("w.raw").alias("value"), F.col("w.t").alias("kind")), "slots"
    )
    if need.isEmpty():
        checked = aligned.select("*", F.lit(0).cast("bigint").alias("n_slots"), F.lit(0).cast("bigint").alias("changed_slots"))
    else:
        asked = need.select("doc_id").distinct()
        seen = base.join(asked, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        seen = seen.select("doc_id", F.posexplode("raw").alias("at", "word"))
        along = ["doc_id", "item_id", "shift"]
        pairs = need.join(seen, ["doc_id", "at"]).select(*along, "kind", "value", F.lower("word").alias("word"), "q").repartition(*along)
        there = pairs.groupBy(*along, "kind", "value", "word").agg(F.count(F.lit(1)).alias("n"), F.collect_list("q").alias("_at"))
        # Each value keeps its commonest word and each word its commonest value; slots beside these conflict.
        same = (F.col("word") == F.col("value")).cast("int")
        of_value = Window.partitionBy(*along, "kind", "value").orderBy(F.desc("n"), same.desc(), "word")
        of_word = Window.partitionBy(*along, "kind", "word").orderBy("_split", F.desc("n"), same.desc(), "value")
        there = there.withColumn("_split", F.row_number().over(of_value) > 1)
        there = there.withColumn("_odd", F.col("_split") | (F.row_number().over(of_word) > 1))
        tally = there.groupBy(*along).agg(
            F.sum("n").alias("n_slots"),
            F.sum(F.when(same == 0, F.col("n")).otherwise(0)).alias("changed_slots"),
            F.sum(F.when(F.col("_split"), F.col("n")).otherwise(0)).alias("_n_split"),
            F.sum(F.when(F.col("_odd"), F.col("n")).otherwise(0)).alias("_n_odd"),
            F.flatten(F.collect_list(F.when(F.col("_odd"), F.col("_at")))).alias("_odd_at"),
        )
        few = (F.col("_n_split") <= F.lit(spec.split) * F.col("n_slots")) & (F.col("_n_odd") <= F.lit(spec.clash) * F.col("n_slots"))
        sound = F.expr(f"size(filter(_qs, x -> NOT exists(_odd_at, p -> p between x and x + {spec.window - 1})))")
        spared = _enough(sound, spec) & (sound >= F.lit(1 - spec.split) * F.col("n_windows"))
        checked = aligned.join(tally, along, "left").where(F.col("n_slots").isNull() | few | spared).select(
            *aligned.columns, F.coalesce("n_slots", F.lit(0)).cast("bigint").alias("n_slots"), F.coalesce("changed_slots", F.lit(0)).cast("bigint").alias("changed_slots")
        )
    kept = F.struct("n_windows", "item_windows", "n_slots", "changed_slots")
    best = checked.groupBy("doc_id", "item_id").agg(F.max_by(kept, F.struct("n_windows", -F.col("shift"))).alias("b"))
    return best.select("doc_id", "item_id", "b.*").select(
        "doc_id", "item_id", "n_windows", F.col("item_windows").cast("bigint").alias("item_windows"), "n_slots", "changed_slots", F.lit(True).alias("contaminated")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, spec: LeakSpec = LeakSpec()) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose document leaks no benchmark item."""
    bad = leaks(docs, benchmark, spec).select(F.col("doc_id").alias("_leak_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_leak_id"], "left_anti")
