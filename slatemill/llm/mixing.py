"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Targets share a budget by weight, none above a cap. Each source's documents stand in scattered order and form one
stream of words, as many times over as the cap allows, cut into blocks of equally many words. The schedule is the
van der Corput sequence: slot i is the bit-reversed i, mapped through the cumulative numbers of blocks that the sources
need. With 2^m slots every source is hit exactly as often as it needs blocks, evenly spread; slots beyond the
last source stay empty. A slot's rank within its source counts the earlier slots of that source. It follows from
the bits of i in closed form, so no source is ever sorted, however large. Slots and blocks join on (source, rank).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage, n_words, ranked_in_chunks

BLOCK_WORDS = 4096
CHUNK_ROWS, MOST_CHUNKS = 256, 65_536
PRIME = (1 << 31) - 1


def shuffled_place(doc_id: str, seed: int) -> str:
    """SQL for a number below PRIME that scatters doc_ids: a linear step, then a product with a part of its own result. Plain
    arithmetic, so that any SQL engine can give the same order."""
    x = f"((({doc_id} % {PRIME} + {PRIME}) % {PRIME}) * 48271 + {seed}) % {PRIME}"
    return f"(({x}) * (({x}) % 46337 + 1)) % {PRIME}"


def source_targets(sized: DataFrame, weights: Sequence[int], budget: float, cap: float) -> DataFrame:
    """(sid, source, source_size, target): one row per source in code-point order, null last; the weights repeat
    along that order. `target` is least(cap x source_size, level x weight) at the level that spends the budget:
    what sharing excess again by weight until none is above its cap comes to."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())                    # one row per source
    s = s.withColumn("sid", (F.row_number().over(order) - 1).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    rising = Window.orderBy("_ratio", "sid")
    upto = rising.rowsBetween(Window.unboundedPreceding, 0)
    after = rising.rowsBetween(1, Window.unboundedFollowing)
    s = (s.withColumn("_ratio", F.col("most") / F.col("weight"))
         .withColumn("_full", F.sum("most").over(upto)).withColumn("_open", F.coalesce(F.sum("weight").over(after), F.lit(0.0)))
         .withColumn("_spend", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))))
    s = s.withColumn("_fits", F.col("_full") + F.col("_ratio") * F.col("_open") <= F.col("_spend"))
    everyone = Window.partitionBy()
    full = F.coalesce(F.max(F.when(F.col("_fits"), F.col("_full"))).over(everyone), F.lit(0.0))
    still = F.sum(F.when(~F.col("_fits"), F.col("weight")).otherwise(0.0)).over(everyone)
    level = F.when(still > 0, (F.col("_spend") - full) / still).otherwise(0.0)
    target = F.when(F.col("_fits"), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return s.select("sid", "source", "source_size", target.alias("target"))


def reversed_bits(i: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def rank_in_source(bits: int) -> Column:
    """Number of slots before slot `i` whose reversed bits lie in [lo, hi), from the reversed bits `cell` of i.

    For each set bit b of i, the 2^b slots that agree with i above bit b and have a 0 there come earlier; their
    cells are evenly spaced, 2^(bits - b) apart, from the low bits of `cell` on."""
    def below(x: str) -> str:
        return f"greatest(0L, least(shiftleft(1L, b), -shiftright(-({x} - (cell & (shiftleft(1L, {bits} - b - 1) - 1L))), {bits} - b)))"

    return F.expr(f"aggregate(sequence(0, {bits} - 1), 0L, (n, b) -> n + IF((shiftright(i, b) & 1L) = 1L, {below('hi')} - {below('lo')}, 0L))")


def schedule(quotas: DataFrame) -> DataFrame:
    """(position, sid, block): which block of which source each slot takes, for sources with `blocks` each."""
    edges = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)      # one row per source
    q = quotas.where("blocks > 0").withColumn("hi", F.sum("blocks").over(edges)).withColumn("lo", F.col("hi") - F.col("blocks"))
    total = q.agg(F.max("hi")).first()[0] or 0
    bits = max(1, (total - 1).bit_length()) if total else 1
    coarse = max(0, bits - 12)
    spans = q.select("sid", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", coarse), F.shiftright(F.col("hi") - 1, coarse))).alias("near"))
    slots = quotas.sparkSession.range(1 << bits).select(F.col("id").alias("i"), reversed_bits(F.col("id"), bits).alias("cell"))
    hit = slots.withColumn("near", F.shiftright("cell", coarse)).join(spans, "near").where("cell >= lo AND cell < hi")
    return hit.select(F.col("i").alias("position"), "sid", rank_in_source(bits).alias("block"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), budget: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source; other columns are ignored): doc_id, source, size, source_size,
    target and taken, the words that the mix takes from it, repeats counted.

    A source takes its rounded target exactly: its last block is cut there. Null sources form a source of their
    own. Null, empty and white-space texts have size 0 and give nothing. Rows that share a doc_id are documents
    of their own. No documents: no rows."""
    sized = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                                    n_words(F.col("text").cast("string")).alias("size"), F.monotonically_increasing_id().alias("row")))
    targets = cut_lineage(source_targets(sized, weights, budget, cap).withColumn("quota", F.floor(F.col("target") + 0.5))
                          .withColumn("blocks", F.ceil(F.col("quota") / F.lit(block_words))))
    plan = schedule(targets)
    bits = max(1, min(MOST_CHUNKS, sized.count() // CHUNK_ROWS).bit_length())
    named = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    shuffled = named.withColumn("h", F.expr(shuffled_place("doc_id", seed)))
    placed = ranked_in_chunks(shuffled, ["sid"], F.shiftright("h", 31 - bits), [F.col(c) for c in ("h", "doc_id", "size", "row")], F.col("size"), "at")
    start = F.col("at") + F.col("source_size") * F.col("pass")
    stop = F.least(start + F.col("size"), F.col("quota"))
    last_pass = F.lit(int(-(-cap // 1)) - 1)
    parts = (placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), last_pass)))
             .select("row", "sid", start.alias("start"), stop.alias("stop")).where("start < stop")
             .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words)))))
    words = F.least("stop", (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    taken = parts.join(plan, ["sid", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    return (named.join(taken, "row", "left")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, each as many times as the mix takes its words, to the nearest whole number. Rows that agree in
    doc_id, source and size share what the mix takes from them."""
    text = F.col("text").cast("string")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words(text).alias("_size"))
    times = F.floor(F.sum("taken") / (F.count("*") * F.col("size")) + 0.5).cast("int")
    share = mix(docs, **options).where("size > 0").groupBy("doc_id", "source", "size").agg(times.alias("_times")).where("_times > 0")
    share = cut_lineage(share.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "_times"))
    # texts are far larger than any count table that may be broadcast at scale; the plan is the same at every size
    both = d.join(share.hint("merge"), F.col("_id").eqNullSafe(F.col("_d")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_size") == F.col("_n")))
    return both.select("doc", F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_i")).select("doc.*")
