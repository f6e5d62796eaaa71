"""Chat formatting in budgeted windows; DataFrame functions only.

A conversation's turns are laid end to end by the prefix sums of their tokens.
The sums are cut into strides; a window holds the turns that begin within one
stride.  Each window opens with the conversation's system turn, repeats the
turns right before its own ones, as many whole ones as fit into ``history``
tokens (behind a longer turn there are none), and then has its own turns.
Repeated turns are masked: the loss covers
the assistants' texts among the window's own turns, so that each is a target once.

A stride is what the budget leaves beside system turn, history and the
conversation's longest turn, but at least half of what it leaves beside the
first two: a window then holds less than a stride plus its last turn.  A turn is
never cut; a window made longer than the budget by one long turn says so
(``over_budget``).

Template: ``<|turn|>`` role, newline, text, ``<|end|>``.  Roles and texts are
escaped: backslashes are doubled, control strings get a backslash behind their
first character, and a role's newlines become a backslash and an n.  So none is
left in a text, and ``unescape`` and ``unescape_role`` undo it.

Null roles and texts count as empty, turns sort by (turn, role, text), nulls
first, and repeated rows are turns of their own.  Other columns of the table
don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common templates, beside those of this one.
CONTROLS = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: What counts as a token: a run of word characters, or one other visible character.
TOKEN = r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
#: Tokens of a turn's marks.
MARK_TOKENS = 4


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # doubled backslashes stand apart, so that none of them is taken for a newline's
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))), "\\")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN), escape_role(role), F.lit("\n"), escape(text), F.lit(END))


def format_windows(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 2048, history: int = 256, targets: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Windows: conv_id, window, formatted, own_start, loss (spans), n_own, n_repeated, n_tokens, over_budget.

    own_start is the place (from 1) of the first own turn in ``formatted``;
    loss is an array of (start, length) within it, in order.  One shuffle by
    conversation: the running sums stream over sorted turns, and windows are
    gathered in place, each no longer than about a budget.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARK_TOKENS)
    rows = rows.withColumn("longest", F.max("tokens").over(Window.partitionBy("conv_id")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.row_number().over(order).alias("ord"), (F.sum("tokens").over(so_far) - F.col("tokens")).alias("before"), F.first("role").over(so_far).alias("r1"), F.first("tokens").over(so_far).alias("t1"))
    room = F.lit(budget) - F.lit(history) - F.when(F.col("r1") == "system", F.col("t1")).otherwise(F.lit(0))
    stride = F.greatest(room - F.col("longest"), room / 2, F.lit(max(history, 1))).cast("long")
    rows = rows.withColumn("stride", stride).withColumn("window", F.floor(F.col("before") / F.col("stride")).cast("long"))
    own_first = F.lag("window").over(order).isNull() | (F.lag("window").over(order) != F.col("window"))
    # the system turn goes where a window opens
    rows = rows.withColumn("own_first", own_first).withColumn("opens", F.col("own_first") & (F.col("r1") == "system") & (F.col("window") > 0)).withColumn("sys_text", F.when(F.col("opens"), F.first("text").over(so_far)))
    # the windows that open within history tokens behind a turn's begin repeat it: two at most, as a stride is no shorter
    ahead = Window.partitionBy("conv_id").orderBy("before").rangeBetween(1, history)
    rows = rows.withColumn("again", F.collect_list(F.when(F.col("own_first"), F.col("window"))).over(ahead))
    rows = rows.withColumn("again", F.when((F.col("ord") == 1) & (F.col("role") == "system"), F.array().cast("array<bigint>")).otherwise(F.col("again")))
    piece = lambda w, kind, o, r, x, n: F.struct(w.alias("window"), kind.alias("kind"), o.alias("ord"), r.alias("role"), x.alias("text"), n.alias("tokens"))
    pieces = F.concat(
        F.array(
            piece(F.col("window"), F.lit(2), F.col("ord"), F.col("role"), F.col("text"), F.col("tokens")),
            F.when(F.col("opens"), piece(F.col("window"), F.lit(0), F.lit(1), F.lit("system"), F.col("sys_text"), F.col("t1"))),
        ),
        F.transform("again", lambda w: piece(w, F.lit(1), F.col("ord"), F.col("role"), F.col("text"), F.col("tokens"))),
    )
    long = rows.select("conv_id", F.explode(F.filter(pieces, lambda p: p.isNotNull())).alias("p")).select("conv_id", "p.*")
    long = long.withColumn("formatted", format_turn(F.col("role"), F.col("text")))
    head = F.length(F.lit(TURN)) + F.length(escape_role(F.col("role"))) + 1
    target = (F.col("kind") == 2) & F.col("role").isin(*targets)
    long = long.select("conv_id", "window", "kind", "ord", "tokens", "formatted", F.length("formatted").alias("chars"), F.when(target, head).alias("head"), F.when(target, F.length(escape(F.col("text")))).alias("loss_chars"))
    grouped = long.groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "ord", "chars", "head", "loss_chars", "formatted"))).alias("g"),
        F.count_if(F.col("kind") == 2).alias("n_own"), F.count_if(F.col("kind") < 2).alias("n_repeated"), F.sum("tokens").alias("n_tokens"),
    )
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    walked = F.aggregate(
        "g", start,
        lambda acc, x: F.struct((acc["at"] + x["chars"]).alias("at"), F.when(x["head"].isNull(), acc["loss"]).otherwise(F.array_append(acc["loss"], F.struct((acc["at"] + x["head"]).alias("start"), x["loss_chars"].alias("length")))).alias("loss")),
    )
    repeated = F.aggregate(F.filter("g", lambda x: x["kind"] < 2), F.lit(1), lambda acc, x: acc + x["chars"])
    return grouped.select("conv_id", "window", F.array_join(F.transform("g", lambda x: x["formatted"]), "").alias("formatted"), repeated.alias("own_start"), walked["loss"].alias("loss"), "n_own", "n_repeated", "n_tokens", (F.col("n_tokens") > budget).alias("over_budget"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped."""
    parts = F.split(formatted, F.lit(END.replace("|", r"\|")), -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda p: F.substring(p, F.lit(len(TURN) + 1), F.length(p))
    role = lambda p: F.substring_index(body(p), "\n", 1)

    def turn(p: Column) -> Column:
        return F.struct(unescape_role(role(p)).alias("role"), unescape(F.substring(p, F.length(role(p)) + len(TURN) + 2, F.length(p))).alias("text"))

    return F.transform(whole, turn)


def own_part(windows: DataFrame) -> Column:
    """A window's text without what it repeats."""
    return F.substring(F.col("formatted"), F.col("own_start"), F.length("formatted"))


def loss_texts(windows: DataFrame) -> Column:
    """The unescaped texts under a window's loss mask."""
    return F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"], x["length"])))
