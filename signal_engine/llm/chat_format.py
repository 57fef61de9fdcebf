"""Chat formatting over reply trees.

Messages with a parent form trees. Paths are enumerated by iterative self-joins that double their reach:
after round k every message knows its 2^k-th ancestor and the score summed on the way, so a path of depth d
takes log2(d) joins. Leaves are ranked by their path's mean score; the paths of the chosen leaves are filled
in by the same tables, and each is formatted as one conversation.

The template is ``<|turn|>`` role newline text newline ``<|end|>`` newline for every turn. Control strings
inside texts and roles get a backslash after their first character (backslashes already there are kept and
counted), so no control string of a text survives and unescaping gives back the exact text; a role's
newlines and backslashes are escaped too. The loss mask lists (start, length) in code points of the escaped
assistant texts.

Defined results: null role or text is empty; rows with a null conversation are one conversation, of key null
(``format_trees`` joins on a key that is never null); messages without a known parent are roots; repeated rows are
kept as messages of their own; equal scores rank by depth (deeper first), then by the leaf's number; a cycle
has no leaf and gives nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signal_engine.llm.common import Scratch

TURN, END = "<|turn|>", "<|end|>"
#: What is escaped inside texts: control strings of this and of other common templates.
CONTROL = r"(<)(\\*)(\|\w+\|>|/?s>|</?SYS>>)|(\[)(\\*)(/?INST\])"
ESCAPED = r"(<)(\\*)\\(\|\w+\|>|/?s>|</?SYS>>)|(\[)(\\*)\\(/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$4$2$5\\$3$6")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$4$2$5$3$6")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    plain = F.regexp_replace(unescape(role), r"\\n", "\n")
    # a doubled backslash before n is a backslash and the letter: set doubled ones apart first
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.when(F.contains(role, F.lit("\\")), F.array_join(parts, "\\")).otherwise(plain)


def chain(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A tree of one branch per conversation from rows by turn: (conv, msg, parent, role, text, score)."""
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    return rows.select("conv", "msg", F.when(F.col("msg") > 1, F.col("msg") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def choose_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """(conv, leaf, branch, depth, msg): the messages of the best ``branches`` root-to-leaf paths of each tree."""
    known = messages.select(F.col("conv"), F.col("msg").alias("parent"))
    nodes = messages.select("conv", "msg", "parent", "score")
    linked = nodes.join(known.withColumn("has", F.lit(True)), ["conv", "parent"], "left").select("conv", "msg", F.when(F.col("has"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    jumps = [scratch.write(linked, "jump-0")]
    while len(jumps) <= 40:
        last = jumps[-1]
        if not last.where("up IS NOT NULL").head(1):
            break
        above = last.select("conv", F.col("msg").alias("up"), F.col("up").alias("next"), F.col("total").alias("t2"), F.col("depth").alias("d2"))
        # messages that know their root stay as they are; every other one's ancestor is there
        doubled = last.where("up IS NOT NULL").join(above, ["conv", "up"]).select("conv", "msg", F.col("next").alias("up"), (F.col("total") + F.col("t2")).alias("total"), (F.col("depth") + F.col("d2")).alias("depth"))
        jumps.append(scratch.write(doubled.unionByName(last.where("up IS NULL")), f"jump-{len(jumps)}"))
    parents = jumps[0].where("up IS NOT NULL").select("conv", F.col("up").alias("msg")).distinct()
    leaves = jumps[-1].where("up IS NULL").join(parents, ["conv", "msg"], "left_anti")
    rank = Window.partitionBy("conv").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "msg")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    path = chosen.select("conv", F.col("msg").alias("leaf"), "branch", "depth", "msg")
    for k in range(len(jumps) - 2, -1, -1):
        # every message reached so far also reaches its 2^k-th ancestor
        up = jumps[k].where("up IS NOT NULL").select("conv", "msg", "up")
        further = path.join(up, ["conv", "msg"]).select("conv", "leaf", "branch", (F.col("depth") - (1 << k)).alias("depth"), F.col("up").alias("msg"))
        path = scratch.write(path.unionByName(further), f"path-{k}")
    return path


def format_paths(messages: DataFrame, paths: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """(conv, branch, formatted, loss_spans): one conversation per path."""
    role, text = escape_role(F.col("role")), escape(F.col("text"))
    turns = paths.join(messages.select("conv", "msg", "role", "text"), ["conv", "msg"]).select(
        "conv", "branch", "depth", F.col("role") == learn_role, F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"), text.alias("body")
    )
    turns = turns.toDF("conv", "branch", "depth", "learn", "head", "body").withColumn("piece", F.concat("head", "body", F.lit(f"\n{END}\n")))
    before = Window.partitionBy("conv", "branch").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    in_order = F.array_sort(F.collect_list(F.struct("depth", "piece", F.when(F.col("learn"), F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"))).alias("span"))))
    return turns.groupBy("conv", "branch").agg(in_order.alias("turns")).select("conv", "branch", F.array_join("turns.piece", "").alias("formatted"), F.array_compact("turns.span").alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """array(struct(role, text)) read back from a formatted conversation."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        body = F.substring(p, at + 1, F.length(p) - at - len(f"\n{END}\n"))
        return F.struct(unescape_role(F.substring(p, F.lit(1), at - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_trees(messages: DataFrame, scratch: Scratch, branches: int = 1, learn_role: str = "assistant") -> DataFrame:
    """Choose the best branches of every tree and format each; messages: (conv, msg, parent, role, text, score)."""
    kind, key = messages.schema["conv"].dataType, F.col("conv").cast("string")
    kept = scratch.write(messages.withColumn("conv", F.coalesce(F.concat(F.lit("="), key), F.lit("-"))), "messages")
    done = format_paths(kept, choose_paths(kept, scratch, branches), learn_role)
    return done.withColumn("conv", F.when(F.col("conv") != "-", F.substr("conv", F.lit(2)).cast(kind)))
