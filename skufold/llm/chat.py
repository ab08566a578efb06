"""Chat formatting of preference pairs.

Chosen and rejected conversations are compared turn by turn; their longest
common prefix of turns is rendered once as the prompt, and what follows in each
is a completion whose mask trains the assistant's words only. Turns meet in a
full join on (pair, turn) and the first difference is a partial aggregate, so a
pair of any length is spread over many tasks. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Turns of one output part: a row never holds more than this many turn numbers.
PART_TURNS = 256
END = "<|end|>\n"


def _turns(df: DataFrame, name: str) -> DataFrame:
    """One row per pair and turn: the messages of that turn, repeats once."""
    rows = df.select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (rows.distinct().groupBy("pair_id", "turn")
            .agg(F.array_sort(F.collect_list(F.struct("role", "text"))).alias(name)))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def _rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(header(m["role"]), m["text"], F.lit(END))), "")


def _mask(messages: Column) -> Column:
    """Runs ``train:characters``: an assistant's header is masked (0), its text
    and end mark are trained (1), other roles are masked whole."""
    def runs(m):
        head, body = F.length(header(m["role"])), F.length(m["text"]) + len(END)
        return F.when(m["role"] == "assistant",
                      F.concat(F.lit("0:"), head.cast("string"), F.lit(",1:"), body.cast("string"))).otherwise(
            F.concat(F.lit("0:"), (head + body).cast("string")))
    return F.array_join(F.transform(messages, runs), ",")


def format_preferences(chosen: DataFrame, rejected: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(pair_id, turn, role, text) twice -> one row per pair and part.

    Columns: pair_id, part, prompt_turns (of the whole pair), prompt, chosen,
    rejected, chosen_mask, rejected_mask, n_chosen, n_rejected (turns after the
    prompt in this part). A conversation of up to ``part_turns`` turn numbers is
    one part 0; a longer one continues in further parts, to be concatenated.
    Null turn: before all others. Null role or text: empty. Equal rows of a turn
    count once; different ones with the same turn are ordered by role and text.
    Null pair ids form one pair. A pair without difference has empty
    completions; one that is on one side only has an empty prompt. Empty tables
    give no rows; other columns are ignored.
    """
    c, r = _turns(chosen, "c"), _turns(rejected, "r")
    r = r.select(F.col("pair_id").alias("_p"), F.col("turn").alias("_t"), "r")
    both = c.join(r, c["pair_id"].eqNullSafe(r["_p"]) & (c["turn"] == r["_t"]), "full").select(
        F.when(F.col("_t").isNull(), F.col("pair_id")).otherwise(F.col("_p")).alias("pair_id"),
        F.coalesce("turn", "_t").alias("turn"), "c", "r")
    both = written(both)
    differ = ~F.col("c").eqNullSafe(F.col("r"))
    first = (both.groupBy(F.col("pair_id").alias("_p"))
             .agg(F.min(F.when(differ, F.col("turn"))).alias("cut"))
             .select(F.struct("_p").alias("_k"), "cut"))
    rows = both.withColumn("_k", F.struct(F.col("pair_id").alias("_p"))).join(first, "_k")
    in_prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = F.floor(F.greatest("turn", F.lit(0)) / part_turns).cast("long")

    def text(of: str, when: Column, what) -> Column:
        return F.when(when & F.col(of).isNotNull(), what(F.col(of)))
    rows = rows.select(
        "pair_id", part.alias("part"), "turn", in_prompt.alias("shared"),
        text("c", in_prompt, _rendered).alias("p"),
        text("c", ~in_prompt, _rendered).alias("ct"), text("c", ~in_prompt, _mask).alias("cm"),
        text("r", ~in_prompt, _rendered).alias("rt"), text("r", ~in_prompt, _mask).alias("rm"))

    def joined(col: str, sep: str = "") -> Column:
        ordered = F.array_sort(F.collect_list(F.when(F.col(col).isNotNull(), F.struct("turn", F.col(col).alias("x")))))
        return F.array_join(F.transform(ordered, lambda x: x["x"]), sep)
    count = lambda c: F.count(c).cast("long")
    out = rows.groupBy("pair_id", "part").agg(
        joined("p").alias("prompt"), joined("ct").alias("chosen"), joined("rt").alias("rejected"),
        joined("cm", ",").alias("chosen_mask"), joined("rm", ",").alias("rejected_mask"),
        count("ct").alias("n_chosen"), count("rt").alias("n_rejected"), count("p").alias("part_prompt_turns"))
    # few rows: a pair has one per PART_TURNS turns
    whole = Window.partitionBy("pair_id")
    return out.select("pair_id", "part", F.sum("part_prompt_turns").over(whole).alias("prompt_turns"), "prompt",
                      "chosen", "rejected", "chosen_mask", "rejected_mask", "n_chosen", "n_rejected")
