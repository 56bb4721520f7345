"""Preference formatting: a shared prompt, and a chosen and a rejected completion with training masks.

The longest common turn prefix of the two conversations is rendered once, as the prompt; what follows in each is its
completion. A mask lists the [start, stop) character spans of a completion that are trained: the texts of assistant
turns with their end mark. At least one turn of each conversation stays in its completion.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatemill.llm.common import cut_lineage, ranked_in_chunks

START, AFTER_ROLE, END = "<|", "|>\n", "<|end|>\n"
CHUNK_ROWS, MOST_CHUNKS = 256, 65_536


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order (by turn, role and text; null first). A null role is a user's,
    a null text empty. Rows without a conv_id belong to no conversation."""
    t = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"),
                 F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    return t.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _ranked(ids: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rank from 0 by conv_id among the rows of the same keys."""
    span = ids.agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, chunks = span.lo or 0, span.hi or 0, max(1, min(MOST_CHUNKS, span.n // CHUNK_ROWS))
    chunk = F.floor((F.col("conv_id").cast("double") - lo) / (float(hi - lo) + 1.0) * chunks)
    return ranked_in_chunks(ids, keys, chunk, [F.col("conv_id")], F.lit(1), name)


def pairs_by_first_turn(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, chosen, rejected) from plain conversations.

    Conversations with the same first turn pair up two by two in conv_id order; the smaller conv_id is chosen. One that is left
    over meets a mismatched reply: its turns up to its last assistant turn, followed by the last assistant turn of the next such
    conversation (after the last comes the first). Conversations left over without an assistant turn, or with no other
    to take a reply from, give no pair. pair_id is the chosen conv_id."""
    last = F.array_max(F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull()))
    keyed = cut_lineage(convs.select("conv_id", F.xxhash64(F.col("turns")[0]["role"], F.col("turns")[0]["text"]).alias("first"), last.alias("last")))
    ranked = cut_lineage(_ranked(keyed, ["first"], "rank").withColumn("pair", F.floor(F.col("rank") / 2)))
    met = ranked.groupBy("first", "pair").agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"), F.count("*").alias("n"), F.max("last").alias("last"))
    met = cut_lineage(met)
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    same = met.where("n = 2").select("chosen_id", "rejected_id").join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id")

    alone = _ranked(met.where("n = 1 AND last IS NOT NULL").select(F.col("chosen_id").alias("conv_id"), "last"), [], "rank")
    alone = cut_lineage(alone)
    n = alone.count()
    give = alone.select(F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("rank"), F.col("conv_id").alias("rejected_id"), F.col("last").alias("reply_at"))
    swap = alone.select(F.col("conv_id").alias("chosen_id"), "rank", "last").join(give, "rank").where("chosen_id <> rejected_id")
    swap = swap.join(side("chosen"), "chosen_id").join(side("other"), F.col("rejected_id") == F.col("other_id"))
    reply = F.element_at("other", (F.col("reply_at") + 1).cast("int"))
    swap = swap.withColumn("rejected", F.concat(F.slice("chosen", F.lit(1), F.col("last")), F.array(reply)))
    columns = [F.col("chosen_id").alias("pair_id"), "chosen_id", "rejected_id", "chosen", "rejected"]
    return same.select(*columns).unionByName(swap.select(*columns))


def _text(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(START), t["role"], F.lit(AFTER_ROLE), t["text"], F.lit(END))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column) -> Column:
    """Spans of the assistant turns of a rendered completion."""
    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.char_length(t["role"]) + len(START) + len(AFTER_ROLE)
        stop = start + F.char_length(t["text"]) + len(END)
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"))))).otherwise(acc["spans"])
        return F.struct(stop.alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<struct<start:int,stop:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair (pair_id, chosen_id, rejected_id, chosen, rejected; turns are arrays of (role, text)): the ids, shared_turns,
    prompt, chosen, rejected, chosen_mask, rejected_mask and same, which is true where nothing sets the two apart.

    A null or empty conversation renders as an empty completion after an empty prompt."""
    empty = F.from_json(F.lit("[]"), "array<struct<role:string,text:string>>")
    p = pairs.withColumn("chosen", F.coalesce("chosen", empty)).withColumn("rejected", F.coalesce("rejected", empty))
    equal = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    first_other = F.array_position(F.concat(equal, F.array(F.lit(False))), False) - 1
    most = F.least(F.size("chosen"), F.size("rejected")) - 1
    p = p.withColumn("n", F.greatest(F.lit(0), F.least(first_other.cast("int"), most)))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("n")))
    return p.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("shared_turns"),
                    _text(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"), _text(rest("chosen")).alias("chosen"), _text(rest("rejected")).alias("rejected"),
                    _mask(rest("chosen")).alias("chosen_mask"), _mask(rest("rejected")).alias("rejected_mask"), F.col("chosen").eqNullSafe(F.col("rejected")).alias("same"))


def preference_rows(turns: DataFrame) -> DataFrame:
    """Preference pairs of a table of turns (conv_id, turn, role, text; other columns are ignored), formatted."""
    return format_pairs(pairs_by_first_turn(cut_lineage(conversations(turns))))
