"""Mixing sources to target weights by weighted fair queueing (operator 1), with DataFrame functions only.

Every source is a queue of its documents in a seeded random order, repeated up to ``repeats`` times. A
document's virtual finish time is the source's words up to its end over the source's target, its start
time the same up to its beginning. The mix is the global order of finish times, cut at the budget; a
document in service at time 1, where a source has had its target, gives the words served by then.

Targets share the budget by weight. A source's target stops at ``repeats`` times its size and the excess
is reshared by weight until no target is above; sorted by cap over weight, the level is a closed form
over running sums, so there is no loop.

Hot sources: running sums are taken in two levels (hash ranges, then rows in a range), so a source that
holds any share of all rows is dealt over ``ranges`` tasks. Source totals are joined by their real size
(Spark broadcasts them only below its threshold, else splits skewed partitions).

Defined results: null texts have size 0 and are never taken; the null source is a source of its own and
sorts last; repeated ids are separate rows; an empty table gives an empty result; other columns are
ignored. Reruns agree: the order is a hash of the seed, the id, the source and the size, and only equal
rows tie.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.plans.lineage import cut

#: A word: what lies between white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, repeats: int = 3) -> DataFrame:
    """(source, source_size, weight, budget, target) from rows of (source, size); one row a source.

    The windows run over one row for each source, after a partially aggregated groupBy.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    by_cap = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(repeats))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    capped = (
        totals.withColumns({"cap": cap, "ratio": cap / F.col("weight"), "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
        .withColumns({"level": level, "place": F.row_number().over(by_cap)})
        .withColumn("capped", F.col("ratio") <= F.col("level"))
    )
    # the first source that is not at its cap sets the level, whatever others have its ratio
    settled = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * settled)
    return capped.select("source", "source_size", "weight", "budget", F.least(target, F.col("cap")).alias("target"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3), share: float = 1.0, repeats: int = 3, seed: int = 17, ranges: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(mix, sized): the mix's items in order of virtual finish, and every document with its source's figures.

    mix: id, source, size, epoch (from 0), finish, taken, position (words of the mix before the item).
    sized: id, source, size, source_size, target, key (the row's place in its queue).
    """
    key = F.xxhash64(F.lit(seed), F.col("id"), F.col("source"), F.col("size"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = cut(rows.withColumn("key", key))
    targets = source_targets(rows, weights=weights, share=share, repeats=repeats)
    sized = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "weight")

    queue = _running(sized, ["source"], "key", "size", F.shiftrightunsigned("key", 64 - (ranges - 1).bit_length()), ["source", "source_size", "target", "budget", "size", "id", "key"])
    times = F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int")
    items = queue.where("size > 0 AND target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1)))
    begin = F.col("before") + F.col("epoch") * F.col("source_size")
    items = items.withColumns({"begin": begin, "finish": (begin + F.col("size")) / F.col("target")})
    items = items.where("begin < target")
    # whole words: what the source has been served by time 1, floored, less what it was served before the item
    items = items.withColumn("taken", F.least(F.col("size"), F.floor("target") - F.col("begin"))).where("taken > 0")
    ordered = _running(items, [], "finish", "taken", F.floor(F.least(F.col("finish"), F.lit(4.0)) * ranges), ["id", "source", "key", "epoch", "finish", "size", "taken", "budget"])
    mix = ordered.withColumn("taken", F.least(F.col("taken"), F.floor("budget") - F.col("before"))).where("taken > 0")
    return mix.select("id", "source", "key", "epoch", "size", "finish", "taken", F.col("before").alias("position")), sized


def _running(df: DataFrame, keys: list[str], order: str, value: str, range_: Column, carry: list[str]) -> DataFrame:
    """``carry`` and ``before``: the sum of ``value`` over the rows of the same ``keys`` that come first by ``order``.

    First over ranges of the order (one small row each), then inside a range.
    """
    df = df.withColumn("range", range_)
    ties = [c for c in ("source", "key", "id", "epoch") if c in df.columns and c != order]
    per = df.groupBy(*keys, "range").agg(F.sum(value).alias("in_range"))
    earlier = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("offset", F.coalesce(F.sum("in_range").over(earlier), F.lit(0)))
    renamed = per.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("range").alias("of_range"), "offset")
    on = F.col("range") == F.col("of_range")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    inside = Window.partitionBy(*keys, "range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    within = df.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return within.join(renamed, on).withColumn("before", F.col("before") + F.col("offset")).select(*carry, "before")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """Per document: id, size, source_size, target, taken (words over all epochs; 0 if never reached)."""
    mix, sized = mix_sources(docs, **options)
    per = mix.groupBy("id", "source", "key").agg(F.sum("taken").alias("words"), F.countDistinct("epoch").cast("int").alias("copies"))
    # equal rows share a key: each of them stands for its own share of the words
    same = sized.groupBy("id", "source", "key", "size", "source_size", "target").agg(F.count(F.lit(1)).alias("rows"))
    per = per.select(F.col("id").alias("i"), F.col("source").alias("s"), F.col("key").alias("k"), "words", "copies")
    on = F.col("id").eqNullSafe(F.col("i")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k"))
    joined = same.join(per, on, "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    words = F.coalesce("words", F.lit(0))
    taken = F.floor(words * F.col("nth") / F.col("rows")) - F.floor(words * (F.col("nth") - 1) / F.col("rows"))
    return joined.select("id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).alias("copies"))
