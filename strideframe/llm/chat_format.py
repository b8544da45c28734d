"""Chat formatting into budgeted windows with loss masks (DataFrame operations only).

Turns are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts are escaped
reversibly: ``<|`` gets a backslash between its two characters, and a ``<|`` that already has some gets one
more; roles percent-encode line feeds, ``<`` and ``%``. A conversation is cut into turn-aligned windows by
a running sum of turn tokens (words and an overhead for the template): a window takes turns while they fit
the budget left beside the system turn and the history. Later windows repeat the system turn and up to
``history_turns`` of the turns before them, and mask those, so every assistant text is a target once.

Defined results: a null text or role is empty; turns are ordered by turn, role, text (nulls first), so
ties and repeated rows have a fixed order; a turn longer than the budget has a window of its own; null
conversation ids form one conversation. One conversation is one row, as its digest needs it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
OVERHEAD = 4  # tokens of the template around a turn


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _windows(turns: Column, room: Column) -> Column:
    """Turn-aligned spans [a, e) of fresh turns by the running sum of their costs."""
    state = F.struct(F.array().cast("array<struct<a:int,e:int>>").alias("done"), F.lit(0).alias("a"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("p"), F.lit(0).alias("i"))

    def step(s, t):
        cut = (s["i"] > s["a"]) & (s["p"] + t["cost"] - s["base"] > room)
        return F.struct(
            F.when(cut, F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("e"))))).otherwise(s["done"]).alias("done"),
            F.when(cut, s["i"]).otherwise(s["a"]).alias("a"),
            F.when(cut, s["p"]).otherwise(s["base"]).alias("base"),
            (s["p"] + t["cost"]).alias("p"),
            (s["i"] + 1).alias("i"),
        )

    return F.aggregate(turns, state, step, lambda s: F.concat(s["done"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("e")))))


def format_chats(turns: DataFrame, budget: int = 512, history_turns: int = 2, history_budget: int = 128) -> DataFrame:
    """(conv_id, window, n_repeated, text, loss) with loss as code point spans (start, len) of ``text``."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(
        F.col("turn").alias("turn"),
        role.alias("role"),
        text.alias("raw"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + OVERHEAD).cast("long").alias("cost"),
    )
    convs = turns.select("conv_id", row.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    s = F.when(F.col("turns")[0]["role"] == "system", 1).otherwise(0)  # leading system turns that stay
    fresh_room = F.lit(budget - history_budget) - F.when(s == 1, F.col("turns")[0]["cost"]).otherwise(0)
    wins = _windows(F.slice("turns", s + 1, F.size("turns")), fresh_room)

    def window(w, k):
        first, end = w["a"] + s, w["e"] + s
        history = F.lit(0)
        total = F.lit(0).cast("long")
        fits = F.lit(True)
        for h in range(1, history_turns + 1):
            at = first - h
            total = total + F.when(at >= s, F.get(F.col("turns"), at)["cost"]).otherwise(0)
            fits = fits & (at >= s) & (total <= history_budget)
            history = F.when(fits, h).otherwise(history)
        context = F.concat(F.slice("turns", 1, s), F.slice("turns", first - history + 1, history))
        return F.struct(k.alias("k"), F.when(k == 0, 0).otherwise(F.size(context)).alias("n_repeated"), F.size(context).alias("n_context"), F.concat(context, F.slice("turns", first + 1, end - first)).alias("turns"))

    rows = convs.select("conv_id", F.explode(F.transform(wins, window)).alias("w")).select("conv_id", F.col("w.k").alias("window"), F.col("w.n_repeated").alias("n_repeated"), F.col("w.n_context").alias("n_context"), F.col("w.turns").alias("turns"))
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,len:int>>").alias("spans"))

    def span(a, t):
        head, body = F.char_length(t["head"]), F.char_length(t["body"])
        target = (t["role"] == "assistant") & (a["i"] >= F.col("n_context"))
        return F.struct(
            (a["at"] + head + body + len(END)).alias("at"),
            (a["i"] + 1).alias("i"),
            F.when(target, F.concat(a["spans"], F.array(F.struct((a["at"] + head).alias("start"), body.alias("len"))))).otherwise(a["spans"]).alias("spans"),
        )

    return rows.select(
        "conv_id",
        "window",
        "n_repeated",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("text"),
        F.aggregate("turns", state, span, lambda a: a["spans"]).alias("loss"),
    )


def read_chats(windows: DataFrame) -> DataFrame:
    """Parse formatted windows again: (conv_id, turns array<struct<role,text>>, loss_text, formatted_chars)."""
    parts = F.slice(F.split("text", r"<\|im_start\|>", -1), F.col("n_repeated") + 2, F.size(F.split("text", r"<\|im_start\|>", -1)))

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        n = F.char_length(role)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(p, n + 2, F.char_length(p) - n - 1 - len(END))).alias("text"))

    one = windows.select(
        "conv_id",
        F.struct(
            F.col("window"),
            F.transform(parts, turn).alias("turns"),
            F.array_join(F.transform("loss", lambda m: unescape(F.substring(F.col("text"), m["start"] + 1, m["len"]))), "").alias("loss"),
            F.char_length("text").cast("long").alias("chars"),
        ).alias("w"),
    )
    whole = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["loss"]), "").alias("loss_text"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )
