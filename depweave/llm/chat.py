"""Chat formatting into budgeted, turn-aligned windows, with DataFrame operations only.

Turns of a conversation are ordered by (turn, role, text) and get prefix sums of
their tokens.  The sums are made in two levels over a range-partitioned table, so
a conversation of any length is spread over many tasks.  A window takes the turns
whose end falls into one cell of the prefix sums; a turn that crosses into a cell
and is longer than the spare room stands alone.  So a window's own turns never
exceed its room, unless a single turn does (texts are never cut).  Every later
window first repeats the conversation's opening system turn and the last turns
before it, up to ``history`` tokens.  Any system turn shorter than the budget is
repeated; where one leaves less than twice the history, history gets half of what it
leaves.  One of the budget or more is said once, in the first window, as no later one
could hold anything beside it.  Repeated turns carry no loss: each assistant turn is a
target exactly once.

Template: ``<turn ROLE>TEXT</turn>`` and ``<repeat ROLE>TEXT</repeat>``, a line
break after each.  In texts and roles a backslash becomes ``\\b`` and ``<`` becomes
``\\l`` (in roles also ``>``: ``\\g``), so no text can hold a control string and the
escape can be undone without loss.  ``loss`` lists the (start, length) spans, in
code points of the formatted string, of the assistant texts that are targets.

Defined results: null roles and texts count as empty; null turns come first; ties
are broken by role and text, and equal rows are turns of their own; a null
conversation id is a conversation; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depweave.session import materialise

BUDGET = 1024
HISTORY = 192
#: Tokens that the template adds to a turn.
OVERHEAD = 4


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(x: Column) -> Column:
    """Every backslash of an escaped string leads an escape, so the order of these is safe."""
    return F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def default_tokens(text: Column) -> Column:
    """Four characters a token, rounded up."""
    return F.expr("0L") + F.ceil(F.char_length(text) / 4).cast("long")


def with_prefix_sums(turns: DataFrame, tokens=default_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, role, text, tokens, before): tokens of the turn and of all turns of the conversation before it."""
    clean = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    clean = clean.withColumn("tokens", tokens(F.col("text")) + OVERHEAD)
    spread = clean.repartitionByRange("conv", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "chat-turns")
    totals = spread.groupBy("conv", "part").agg(F.sum("tokens").alias("all"))
    earlier = F.sum("all").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialise(totals.select("conv", "part", F.coalesce(earlier, F.lit(0)).alias("base")), "chat-bases")
    inner = F.sum("tokens").over(Window.partitionBy("conv", "part").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1))
    local = spread.withColumn("local", F.coalesce(inner, F.lit(0))).alias("t")
    b = bases.alias("b")
    joined = local.join(b, F.col("t.conv").eqNullSafe(F.col("b.conv")) & (F.col("t.part") == F.col("b.part")))
    return materialise(joined.select("t.conv", "role", "text", "tokens", (F.col("local") + F.col("base")).alias("before")), "chat-prefix")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=default_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per window: conv_id, window (its order), n_tokens, formatted, loss."""
    summed = with_prefix_sums(turns, tokens, conv_col, turn_col, role_col, text_col)
    opening = materialise(summed.where((F.col("before") == 0) & (F.col("role") == "system") & (F.col("tokens") < budget)).select(F.col("conv").alias("c0"), F.col("text").alias("system"), F.col("tokens").alias("system_tokens")), "chat-system")
    left = F.lit(budget) - F.coalesce("system_tokens", F.lit(0))
    t = summed.join(opening, F.col("conv").eqNullSafe(F.col("c0")), "left").drop("c0").withColumn("hist", F.least(F.lit(history), F.floor(left / 2))).withColumn("room", left - F.col("hist")).withColumn("cell", F.expr("greatest(1, room * 3 div 4)"))
    end_cell = F.expr("(before + tokens - 1) div cell")
    alone = (end_cell > F.expr("before div cell")) & (F.col("tokens") > F.col("room") - F.col("cell"))
    t = materialise(t.select("conv", "role", "text", "tokens", "before", "hist", (end_cell * 2 + F.when(alone, 0).otherwise(1)).alias("window")), "chat-assigned")
    starts = materialise(t.groupBy("conv", "window").agg(F.min("before").alias("start")).where("start > 0").select(F.col("conv").alias("wc"), F.col("window").alias("w"), "start", F.expr(f"start div {history}").alias("slot")), "chat-starts")
    past = t.where(~((F.col("before") == 0) & (F.col("role") == "system"))).withColumn("slot", F.explode(F.expr(f"array(before div {history}, before div {history} + 1)")))
    near = (F.col("before") + F.col("tokens") <= F.col("start")) & (F.col("start") - F.col("before") <= F.col("hist"))
    repeated = past.alias("p").join(starts.alias("s"), F.col("p.conv").eqNullSafe(F.col("s.wc")) & (F.col("p.slot") == F.col("s.slot")) & near)
    cols = ["conv", "window", "before", "tokens", "role", "text", "again"]
    first = starts.join(opening, F.col("wc").eqNullSafe(F.col("c0")))
    again = F.lit(True).alias("again")
    rows = (
        t.select("conv", "window", "before", "tokens", "role", "text", F.lit(False).alias("again"))
        .unionByName(repeated.select("conv", F.col("w").alias("window"), "before", "tokens", "role", "text", again))
        .unionByName(first.select(F.col("wc").alias("conv"), F.col("w").alias("window"), F.lit(-1).cast("long").alias("before"), F.col("system_tokens").alias("tokens"), F.lit("system").alias("role"), F.col("system").alias("text"), again))
    )
    grouped = rows.groupBy("conv", "window").agg(F.array_sort(F.collect_list(F.struct(*cols[2:]))).alias("m"), F.sum("tokens").alias("n_tokens"))

    def message(x: Column) -> Column:
        kind = F.when(x["again"], "repeat").otherwise("turn")
        head = F.concat(F.lit("<"), kind, F.lit(" "), F.replace(escape(x["role"]), F.lit(">"), F.lit("\\g")), F.lit(">"))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), F.concat(F.lit("</"), kind, F.lit(">\n")).alias("tail"), ((x["role"] == "assistant") & ~x["again"]).alias("target"))

    span = "array<struct<start:int,length:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start, size = acc["at"] + F.char_length(x["head"]), F.char_length(x["body"])
        one = F.array(F.struct(start.alias("start"), size.alias("length"))).cast(span)
        return F.struct((start + size + F.char_length(x["tail"])).alias("at"), F.when(x["target"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    shaped = grouped.select(F.col("conv").alias(conv_col), "window", "n_tokens", F.transform("m", message).alias("m"))
    return shaped.select(
        conv_col, "window", "n_tokens",
        F.array_join(F.transform("m", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.aggregate("m", zero, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The messages of a formatted window: array of (again, role, text), unescaped."""
    pattern = r"<(turn|repeat) ([^<>]*)>([^<]*)</"
    part = [F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(F.arrays_zip(part[0].alias("k"), part[1].alias("r"), part[2].alias("t")), lambda x: F.struct((x["k"] == "repeat").alias("again"), unescape(x["r"]).alias("role"), unescape(x["t"]).alias("text")))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the windows alone: turns, masked text and sizes.

    A digest needs its conversation's text in order; runs of windows are joined
    first, so that few rows meet in the last step.
    """
    own = formatted.select(
        conv_col, "window", F.filter(read_back(F.col("formatted")), lambda x: ~x["again"]).alias("m"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("parts"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    text = own.select(
        conv_col, "window", F.expr("window div 128").alias("block"), F.size("m").cast("long").alias("turns"), "chars",
        F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), F.array_join("parts", "").alias("loss"),
    )
    for key, keys in (("window", [conv_col, "block"]), ("block", [conv_col])):
        text = text.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(key, "said", "loss"))).alias("x"), F.sum("turns").alias("turns"), F.sum("chars").alias("chars"))
        text = text.select(*keys, "turns", "chars", F.array_join("x.said", "").alias("said"), F.array_join("x.loss", "").alias("loss"))
    return text.select(
        conv_col, F.col("turns").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.col("chars").alias("formatted_chars"),
    )
