"""Preference pairs from conversations, in DataFrame functions only.

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows in either is rendered as a masked
completion.  Everything works on rows of turns: the first difference is a
minimum per pair, so no conversation is ever gathered in one value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED = "assistant"


def clean_turns(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation and turn number.  Rows without either are no
    turns; of several rows for one turn the smallest role and text stays; a
    null role or text is empty."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    out = turns.filter(F.col(conv).isNotNull() & F.col("turn").isNotNull()).groupBy(F.col(conv).alias("conv"), "turn").agg(F.min(said).alias("s"))
    return out.select("conv", "turn", "s.role", "s.text")


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """(chosen, rejected) of conversations with the same first turn: the longest,
    of equals the smallest id, is chosen against each of the others."""
    first = turns.groupBy("conv").agg(F.min(F.struct("turn", "role", "text")).alias("f"), F.count(F.lit(1)).alias("n"))
    first = first.select("conv", "n", F.sha2(F.concat_ws("\u0000", "f.role", "f.text"), 256).alias("opening"))
    best = first.groupBy("opening").agg(F.min(F.struct((-F.col("n")).alias("n"), "conv")).alias("b"), F.count(F.lit(1)).alias("members"))
    joined = first.join(best.select("opening", F.col("b.conv").alias("chosen"), "members"), "opening")
    return joined.select("chosen", F.col("conv").alias("rejected"), "members")


def swapped(turns: DataFrame) -> DataFrame:
    """Each conversation of two trained turns or more, with the text of the last
    one replaced by that of the one before."""
    said = turns.filter(F.col("role") == TRAINED)
    last = said.groupBy("conv").agg(F.max("turn").alias("last"))
    before = (said.join(last, "conv").filter(F.col("turn") < F.col("last")).groupBy("conv")
              .agg(F.max(F.struct("turn", "text")).alias("b"), F.first("last").alias("last")).select("conv", "last", F.col("b.text").alias("earlier")))
    text = F.when(F.col("turn") == F.col("last"), F.col("earlier")).otherwise(F.col("text"))
    return turns.join(before, "conv").select("conv", "turn", "role", text.alias("text"))


def render(sides: DataFrame) -> DataFrame:
    """Rows (chosen, rejected, kind, side, turn, role, text) of both sides of
    each pair as rendered segments: part (prompt, chosen, rejected), turn, role,
    rendered, and the span of characters to train on (both 0 for none)."""
    keys = ["chosen", "rejected", "kind"]
    said = F.struct("role", "text")
    both = sides.groupBy(*keys, "turn").agg(F.max(F.when(F.col("side") == "chosen", said)).alias("c"), F.max(F.when(F.col("side") == "rejected", said)).alias("r"))
    differ = both.filter(~F.col("c").eqNullSafe(F.col("r"))).groupBy(*keys).agg(F.min("turn").alias("split"))
    out = both.join(differ, keys, "left")
    part = lambda name, s: F.struct(F.lit(name).alias("part"), F.col(s).alias("s"))
    same = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    out = out.withColumn("p", F.explode(F.when(same, F.array(part("prompt", "c"))).otherwise(
        F.filter(F.array(part("chosen", "c"), part("rejected", "r")), lambda p: p["s"].isNotNull()))))
    role, text = F.col("p.s.role"), F.col("p.s.text")
    trained = (F.col("p.part") != "prompt") & (role == TRAINED)
    start = F.length(role) + len(HEAD) + len(MIDDLE)
    return out.select(*keys, F.col("p.part").alias("part"), "turn", role.alias("role"),
                      F.concat(F.lit(HEAD), role, F.lit(MIDDLE), text, F.lit(TAIL)).alias("rendered"),
                      F.when(trained, start).otherwise(0).cast("long").alias("train_start"),
                      F.when(trained, start + F.length(text) + len(TAIL) - 1).otherwise(0).cast("long").alias("train_end"))


def preference_format(conversations: DataFrame, conv: str = "conv_id") -> DataFrame:
    """All preference pairs of a table of conversations, rendered.

    Conversations with a common first turn pair with the longest of them
    (kind ``sibling``); one alone pairs with its swapped version (kind
    ``swap``, both ids equal), if it has two trained turns.  A pair without any
    difference is all prompt.  An empty table gives no rows."""
    turns = clean_turns(conversations, conv)
    members = sibling_pairs(turns)
    pairs = members.filter("chosen <> rejected").select("chosen", "rejected")
    alone = members.filter("members = 1").select(F.col("chosen").alias("conv"))
    side = lambda df, kind, name: df.select("chosen", "rejected", F.lit(kind).alias("kind"), F.lit(name).alias("side"), "turn", "role", "text")
    own = lambda df: df.withColumns({"chosen": F.col("conv"), "rejected": F.col("conv")})
    other = swapped(turns).join(alone, "conv")
    sides = side(pairs.join(turns, F.col("chosen") == F.col("conv")), "sibling", "chosen").unionByName(
        side(pairs.join(turns, F.col("rejected") == F.col("conv")), "sibling", "rejected")).unionByName(
        side(own(other), "swap", "rejected")).unionByName(
        side(own(turns.join(other.select("conv").distinct(), "conv")), "swap", "chosen"))
    return render(sides)
