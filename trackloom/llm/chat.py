"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens, taken by a window function, choose turn-aligned spans: a window is as many turns as fit its
budget after the system turn and a limited stretch of earlier turns, which it repeats. Repeated turns are marked and
never under the loss mask, so each assistant text is a target once.

Turns are marked by control strings of the template. ``&``, ``<`` and ``[`` inside roles and texts become character
references, so neither this template's marks nor those of others (``</s>``, ``[INST]``) can arise from a text, and
reading back restores every character.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, AGAIN, CLOSE = "<|im_start|>", "<|again|>", "<|im_end|>\n"
#: In this order when escaping, in the other when reading back.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Tokens that a turn's marks take.
MARKS = 4


def escape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), REFERENCES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, r: F.replace(t, F.lit(r[1]), F.lit(r[0])), REFERENCES[::-1], text)


def estimated_tokens(text: Column) -> Column:
    """Runs of up to four word characters, and single other signs."""
    return F.regexp_count(text, F.lit(r"\w{1,4}|[^\w\s]"))


def format_windows(turns: DataFrame, budget: int = 1024, history: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, loss (array of start, end in code points of text, end
    exclusive), n_tokens.

    Turns are ordered by turn, role and text; nulls sort first, and null roles and texts are empty. A turn is never cut:
    one longer than the budget stands in its window with the system turn alone. A first turn of role ``system`` leads every window. Rows
    without conv_id form one conversation. ``tokens`` counts a text's tokens (an estimate unless given)."""
    given = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.lit(MARKS) + F.coalesce(tokens if tokens is not None else estimated_tokens(F.col(text_col)), F.lit(0))).cast("long").alias("size"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = given.withColumn("at", F.row_number().over(order) - 1)
    lead = (F.col("at") == 0) & (F.col("role") == "system")
    summed = numbered.withColumn("lead", lead).withColumn("end", F.sum(F.when(F.col("lead"), 0).otherwise(F.col("size"))).over(Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    before = summed.withColumn("before", F.when(F.col("lead"), -1).otherwise(F.col("end") - F.col("size")))
    # the earliest turn from which all up to this one take at most `history` tokens
    past = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)
    body = ~F.col("lead")
    reach = before.withColumn("past_at", F.min(F.when(body, F.col("at"))).over(past)).withColumn("past_before", F.min(F.when(body, F.col("before"))).over(past))
    turn = F.struct("at", "role", "text", "lead", "size", "before", "end", "past_at", "past_before")
    convs = reach.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    led = convs.withColumn("n_lead", F.get("turns", 0)["lead"].cast("int")).withColumn("lead_size", F.when(F.col("n_lead") == 1, F.get("turns", 0)["size"]).otherwise(0))
    # history that leaves a turn no room is not repeated before it
    fits = lambda t: t["end"] - t["past_before"] + F.col("lead_size") <= budget
    led = led.withColumn("turns", F.transform("turns", lambda t: F.struct(
        t["at"], t["role"], t["text"], t["lead"], t["size"], t["before"], t["end"], F.when(fits(t), t["past_at"]).otherwise(t["at"]).alias("past_at"), F.when(fits(t), t["past_before"]).otherwise(t["before"]).alias("past_before"),
    )))

    def fold(s: Column, t: Column) -> Column:
        room = t["past_before"] + F.lit(budget) - F.col("lead_size")
        opened = F.struct(F.concat(s["starts"], F.array(t["at"])).alias("starts"), room.alias("limit"))
        return F.when(t["lead"] | (t["end"] <= s["limit"]), s).otherwise(opened)

    starts = F.aggregate("turns", F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-1).cast("long").alias("limit")), fold, lambda s: s["starts"])
    split = led.withColumn("starts", starts).withColumn("starts", F.when(F.size("starts") == 0, F.array(F.col("n_lead"))).otherwise(F.col("starts")))

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        past_at = F.when(k == 0, start).otherwise(F.coalesce(F.get("turns", start)["past_at"], start))
        mark = lambda part, again: F.transform(part, lambda t: F.struct(t["role"], t["text"], t["size"], again.alias("again")))
        return F.struct(k.alias("window"), F.concat(
            mark(F.slice("turns", 1, F.col("n_lead")), k > 0), mark(F.slice("turns", past_at + 1, start - past_at), F.lit(True)), mark(F.slice("turns", start + 1, end - start), F.lit(False)),
        ).alias("parts"))

    windows = split.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.window", "w.parts")
    head = lambda p: F.concat(F.lit(OPEN), F.replace(escape(p["role"]), F.lit("\n"), F.lit("&#10;")), F.when(p["again"], AGAIN).otherwise(""), F.lit("\n"))
    drawn = windows.withColumn("drawn", F.transform("parts", lambda p: F.struct(head(p).alias("head"), escape(p["text"]).alias("body"), ((p["role"] == "assistant") & ~p["again"]).alias("target"))))

    def spans(s: Column, d: Column) -> Column:
        start = s["at"] + F.length(d["head"])
        end = start + F.length(d["body"])
        return F.struct((end + len(CLOSE)).alias("at"), F.when(d["target"], F.concat(s["loss"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["loss"]).alias("loss"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return drawn.select(
        "conv_id", "window", F.array_join(F.transform("drawn", lambda d: F.concat(d["head"], d["body"], F.lit(CLOSE))), "").alias("text"),
        F.aggregate("drawn", none, spans, lambda s: s["loss"]).alias("loss"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["size"]).alias("n_tokens"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: conv_id, n_turns, turns_sha256 (role, newline, text, newline
    of each turn), loss_chars, loss_sha256 (all text under the mask), formatted_chars, n_windows."""
    pieces = F.split("text", CLOSE.replace("|", r"\|"))
    cut = windows.withColumn("pieces", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(OPEN) + 1))))
    fresh = F.filter("pieces", lambda p: ~F.substring_index(p, "\n", 1).endswith(AGAIN))
    role = lambda p: F.substring_index(p, "\n", 1)
    said = F.transform("fresh", lambda p: F.concat(unescape(F.replace(role(p), F.lit("&#10;"), F.lit("\n"))), F.lit("\n"), unescape(F.substr(p, F.length(role(p)) + 2)), F.lit("\n")))
    loss = F.transform("loss", lambda x: unescape(F.substr("text", x["start"] + 1, x["end"] - x["start"])))
    parts = cut.withColumn("fresh", fresh).select("conv_id", "window", F.array_join(said, "").alias("said"), F.array_join(loss, "").alias("loss"), F.size("fresh").alias("n"), F.length("text").alias("chars"))
    convs = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows"))
    all_loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return convs.select(
        "conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda x: x["said"]), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(all_loss).cast("long").alias("loss_chars"), F.sha2(all_loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )
