"""Chat samples in budgeted windows of whole turns, with a reversible template and a loss mask.

DataFrame functions only. Prefix sums of turn tokens cut a conversation into spans; every span becomes a sample that
opens with the conversation's system turn and the last turns before the span. Only turns that are new in a span and spoken
by the assistant are targets, so each is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketry.llm.common import WORD

BUDGET, HISTORY = 1024, 2
TARGET, SYSTEM = "assistant", "system"
OPEN, HEAD_END, CLOSE = "<turn ", ">", "</turn>\n"


def escaped(text: Column) -> Column:
    r"""No `<` is left, so no marker can occur inside: `\` becomes `\b`, then `<` becomes `\l`."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(">"), F.lit("\\g"))


def _plain_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\g"), F.lit(">")))


def spans(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Turns with their number in the conversation, their tokens and `span`, the window in which they are new.

    Tokens are words plus two for the markers. The system turn and the repeated turns take their room first; half of
    what is left is the step of the prefix sums, because the first turn of a span may begin before its step. So a
    span fits the budget if no turn is longer than the step; a longer turn stays whole and its window is marked `over_budget`.
    Turns are ordered by turn number, then role and text; rows with a null conv_id are one conversation. A null text or role is empty.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumn("tokens", F.regexp_count("text", F.lit(WORD)) + 2)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = W.partitionBy("conv_id")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("upto", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("is_head", (F.col("at") == 1) & (F.col("role") == SYSTEM))
    head = F.max(F.when(F.col("is_head"), F.col("tokens"))).over(whole)
    longest = F.max("tokens").over(whole)
    room = F.lit(budget) - F.coalesce(head, F.lit(0)) - F.least(F.lit(history) * longest, F.lit(budget // 4))
    rows = rows.withColumn("step", F.greatest(F.floor(room / 2), F.lit(1)))
    return rows.withColumn("span", F.floor((F.col("upto") - 1) / F.col("step")))


def _block(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), _escaped_role(turn["role"]), F.lit(HEAD_END), escaped(turn["text"]), F.lit(CLOSE))


def samples(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(conv_id, span, n_repeated, formatted, loss_start, loss_length, tokens, over_budget): one row per window.

    `formatted` holds the blocks `<turn role>text</turn>` of the system turn and the repeated turns (`n_repeated` in all) and of the
    new turns. `loss_start` and `loss_length` are arrays of code points, the escaped text of each new assistant turn.
    Repeated turns fit a quarter of the budget, the nearest ones first. An empty table gives no rows.
    """
    rows = spans(turns, budget, history)
    order = W.partitionBy("conv_id").orderBy("at")
    # a turn is repeated in a later span if one of the next `history` turns opens that span
    later = []
    for j in range(1, history + 1):
        here, before = F.lead("span", j).over(order), F.lead("span", j - 1).over(order)
        later.append(F.when(here > before, F.struct(here.alias("span"), F.lit(j).alias("back"))))
    here = F.array(F.struct("span", F.lit(0).alias("back")))
    places = F.when(F.col("is_head"), here).otherwise(F.concat(here, F.array_compact(F.array(*later))))
    parts = ["conv_id", "at", "role", "text", "tokens"]
    placed = rows.withColumn("places", places).select(*parts, F.inline("places"))
    # the system turn joins the other spans: a row for each, and no turn carries the list of all
    heads = rows.filter("is_head").select(*parts, F.col("span").alias("own"))
    every = rows.select(F.col("conv_id").alias("same"), "span").distinct()
    others = heads.join(every, F.col("conv_id").eqNullSafe(F.col("same"))).filter("span <> own")
    placed = placed.unionByName(others.select(*parts, "span", F.lit(-1).alias("back")))
    turn = F.struct("at", "role", "text", "tokens", "back")
    windows = placed.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    # history that does not fit its quarter is left out, farthest first
    near = F.expr(f"filter(t, x -> x.back <= 0 OR aggregate(filter(t, y -> y.back > 0 AND y.back <= x.back), 0, (s, y) -> s + y.tokens) <= {budget // 4})")
    windows = windows.withColumn("t", near).withColumn("blocks", F.transform("t", _block))
    windows = windows.withColumn("ends", F.expr("transform(blocks, (b, i) -> aggregate(slice(blocks, 1, i + 1), 0, (s, x) -> s + char_length(x)))"))
    mine = F.expr(f"filter(transform(t, (x, i) -> struct(i, x.role AS role, x.back AS back)), x -> x.back = 0 AND x.role = '{TARGET}')")
    windows = windows.withColumn("mine", mine)
    size = f"char_length(get(blocks, x.i)) - {len(OPEN) + len(TARGET) + len(HEAD_END) + len(CLOSE)}"
    return windows.select(
        "conv_id", "span",
        F.size(F.filter("t", lambda x: x["back"] != 0)).alias("n_repeated"),
        F.array_join("blocks", "").alias("formatted"),
        F.expr(f"transform(mine, x -> get(ends, x.i) - {len(CLOSE)} - ({size}))").alias("loss_start"),
        F.expr(f"transform(mine, x -> {size})").alias("loss_length"),
        F.expr("aggregate(t, 0, (s, x) -> s + x.tokens)").alias("tokens"),
    ).withColumn("over_budget", F.col("tokens") > budget)


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, parsed from its windows.

    The digests are of one string per conversation, so its turns meet in one row here; the samples themselves do not need that.
    """
    blocks = F.filter(F.split("formatted", CLOSE), lambda b: b != F.lit(""))
    parsed = windows.withColumn("b", F.slice(blocks, F.col("n_repeated") + 1, F.greatest(F.size(blocks), F.lit(1))))
    turn = F.transform(
        "b",
        lambda b: F.concat(
            _plain_role(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), HEAD_END, 1)), F.lit("\n"),
            unescaped(F.substr(b, F.instr(b, HEAD_END) + 1)), F.lit("\n"),
        ),
    )
    loss = F.transform(F.arrays_zip("loss_start", "loss_length"), lambda x: unescaped(F.substr("formatted", x["loss_start"] + 1, x["loss_length"])))
    each = parsed.select(
        "conv_id", "span", F.size("b").alias("n"), F.array_join(turn, "").alias("turns"), F.array_join(loss, "").alias("loss"),
        F.char_length("formatted").cast("bigint").alias("chars"),
    )
    whole = each.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sort_array(F.collect_list(F.struct("span", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    whole = whole.withColumn("turns", F.array_join(F.col("w.turns"), "")).withColumn("loss", F.array_join(F.col("w.loss"), ""))
    return whole.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts hold the template's own markers."""
    said = "\\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
