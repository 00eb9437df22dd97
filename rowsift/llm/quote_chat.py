"""Chat formatting by quotation linking (DataFrame functions only).

A line that starts with ``>`` marks is quoted, its level is their number. Runs of lines of one
level are passages; each passage and each of its lines is normalised (lower case, single blanks)
and hashed. A quoted passage is joined to the first message of its conversation that holds the
same words unquoted. A message replies to the message of its outermost matching quotation (the
longest one, if several have that level). Threads follow from pointer doubling over the replies.
``place`` numbers the messages of a thread along a depth-first walk of its replies, by pointer
doubling over the walk; ``conversations`` puts the texts together in that order, quoted lines gone.

Scale: only conversations with a quotation are taken apart; originals are aggregated to one row per
conversation and hash before the join and written, so that a conversation holding many rows can
be split by the adaptive skew join. Siblings are put in order by sampled ranges, the walk's steps meet
by message, and a thread's text is cut into parts of a bounded number of messages, so no group grows
with a conversation.

Defined results: a null text is an empty message; a null conversation or turn is linked with
nothing and is a thread of its own; equal rows get equal results; rows with the same conversation
and turn are one message for threads (``conversations`` has their different texts one after the other,
equal ones once); an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowsift.llm.common import BLANK_RUN, BLANKS
from rowsift.operators.attach import attach
from rowsift.operators.ordered import running
from rowsift.session import cut_lineage

#: Messages in one part of a thread's text.
PART = 1000

#: A quoted line, and its marks.
MARKS = r"^[ \t]*((?:>[ \t]*)+)"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(text), F.lit(BLANKS)), BLANK_RUN, " ")


def level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def messages(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    at = rows.select(rows[conv_col].cast("long").alias("conv_id"), rows[turn_col].cast("long").alias("turn"),
                     rows[role_col].cast("string").alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("text"))
    lines = F.split("text", "\n", -1)
    quoted = F.filter(lines, lambda x: level(x) > 0)
    return at.withColumn("mid", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("n_quoted", F.size(quoted).cast("long")) \
        .withColumn("clean", F.when(F.col("n_quoted") > 0, F.trim(F.array_join(F.filter(lines, lambda x: level(x) == 0), "\n"), F.lit(BLANKS)))
                    .otherwise(F.col("text")))


def passages(at: DataFrame) -> DataFrame:
    """mid, conv_id, turn, level, size, hash of the passages and lines of messages in conversations with quotations."""
    convs = at.where("n_quoted > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id").distinct()
    lines = (at.join(convs, "conv_id", "left_semi").where("turn IS NOT NULL")
             .select("mid", "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).dropDuplicates(["mid", "pos"])
             .withColumn("level", level(F.col("line")))
             .withColumn("words", normalised(F.regexp_replace("line", MARKS, ""))))
    order = Window.partitionBy("mid").orderBy("pos")
    runs = (lines.withColumn("new", (F.col("level") != F.lag("level", 1, -1).over(order)).cast("int"))
            .withColumn("run", F.sum("new").over(order)).where("words <> ''")
            .groupBy("mid", "conv_id", "turn", "level", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "words"))).alias("w")))
    words = F.transform("w", lambda x: x["words"])
    units = F.array_distinct(F.concat(F.array(F.array_join(words, " ")), words))
    return runs.select("mid", "conv_id", "turn", "level", F.explode(units).alias("u")) \
        .select("mid", "conv_id", "turn", "level", F.length("u").alias("size"), F.xxhash64("u").alias("hash"))


def replies(at: DataFrame) -> DataFrame:
    """mid, conv_id, turn, reply_to of messages whose quotation has an original."""
    units = cut_lineage(passages(at), "passages")
    originals = cut_lineage(units.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("first")), "originals")
    hits = units.where("level > 0").join(originals, ["conv_id", "hash"]).where("first < turn")
    best = hits.groupBy("mid", "conv_id", "turn").agg(F.min(F.struct(F.col("level"), (-F.col("size")).alias("s"), F.col("first"))).alias("b"))
    return cut_lineage(best.select("mid", "conv_id", "turn", F.col("b.first").alias("reply_to")), "replies")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread (the first message's turn), depth of every message with a reply_to."""
    up = cut_lineage(links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("thread")).withColumn("depth", F.lit(1).cast("long")), "threads")
    while True:
        over = up.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("t2"), F.col("depth").alias("d2"))
        now = cut_lineage(up.join(over, ["conv_id", "thread"], "left").select(
            "conv_id", "turn", F.coalesce("t2", "thread").alias("thread"), (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth"),
            F.col("t2").isNotNull().alias("moved")), "threads")
        up = now.drop("moved")
        if now.where("moved").isEmpty():
            return up


def walk(links: DataFrame) -> DataFrame:
    """conv_id, turn, left of every message with a reply_to or an answer: left counts the messages from this one to
    the end of its thread's depth-first walk, where the answers to one message come by turn.

    A message is entered and left; each of these steps knows its next one: the first answer, the next
    sibling, or leaving what it answers. Doubling adds up the entered messages; finished steps wait aside."""
    up = links.groupBy("conv_id", "turn").agg(F.min("reply_to").alias("parent")).withColumn("one", F.lit(1).cast("long"))
    order = cut_lineage(running(up, ["conv_id", "parent"], "turn", ["one"]), "siblings")
    step = lambda turn, out: F.struct(F.col(turn).alias("turn"), F.lit(out).alias("out"))
    none = F.lit(None).cast("long")
    nodes = order.select("conv_id", "turn", "parent", "next_v").unionByName(
        order.select("conv_id", F.col("parent").alias("turn")).distinct().join(order.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti")
        .withColumn("parent", none).withColumn("next_v", none))
    first = order.where("cum_one = 1").select("conv_id", F.col("parent").alias("turn"), F.col("turn").alias("child"))
    nodes = cut_lineage(nodes.join(first, ["conv_id", "turn"], "left"), "nodes")
    enter = nodes.select("conv_id", step("turn", 0).alias("at"), F.coalesce(F.when(F.col("child").isNotNull(), step("child", 0)), step("turn", 1)).alias("to"),
                         F.lit(1).cast("long").alias("left"))
    leave = nodes.select("conv_id", step("turn", 1).alias("at"), F.when(F.col("next_v").isNotNull(), step("next_v", 0))
                         .when(F.col("parent").isNotNull(), step("parent", 1)).alias("to"), F.lit(0).cast("long").alias("left"))
    now = cut_lineage(enter.unionByName(leave), "walk")
    while not (going := now.where("to IS NOT NULL")).isEmpty():
        over = now.select("conv_id", F.col("at").alias("to"), F.col("to").alias("to2"), F.col("left").alias("left2"))
        moved = going.join(over, ["conv_id", "to"]).select("conv_id", "at", F.col("to2").alias("to"), (F.col("left") + F.col("left2")).alias("left"))
        now = cut_lineage(moved.unionByName(now.where("to IS NULL")), "walk")
    return now.where("at.out = 0").select("conv_id", F.col("at.turn").alias("turn"), "left")


def ways(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread, depth, place (from 0) of every message with a reply_to."""
    up, left = threads(links), cut_lineage(walk(links), "walked")
    sizes = up.select("conv_id", F.col("thread").alias("turn")).distinct().join(left, ["conv_id", "turn"]) \
        .select("conv_id", F.col("turn").alias("thread"), F.col("left").alias("size"))
    at = attach(up.join(left, ["conv_id", "turn"]), sizes, ["conv_id", "thread"])
    return at.select("conv_id", "turn", "thread", "depth", (F.col("size") - F.col("left")).alias("place"))


def link(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, thread, place, depth, turn, role, reply_to, n_quoted, text (without quotations), formatted."""
    at = messages(rows, conv_col, turn_col, role_col, text_col)
    links = replies(at)
    placed = ways(links).withColumnsRenamed({"conv_id": "_c", "turn": "_t"})
    at = at.join(links.select("mid", "reply_to"), "mid", "left")
    at = at.join(placed, (at["conv_id"] == placed["_c"]) & (at["turn"] == placed["_t"]), "left")
    zero = F.lit(0).cast("long")
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"))
    return at.select("conv_id", F.coalesce("thread", "turn").alias("thread"), F.coalesce("place", zero).alias("place"), F.coalesce("depth", zero).alias("depth"),
                     "turn", "role", "reply_to", "n_quoted", F.col("clean").alias("text"), F.concat(head, F.col("clean"), F.lit("<|end|>\n")).alias("formatted"))


def conversations(linked: DataFrame, part: int = PART) -> DataFrame:
    """conv_id, thread, part (from 0), n_messages, text: each thread's formatted messages in the order of their places,
    in parts of ``part`` messages; joined, the parts are the whole thread. A message without conversation or turn
    is a part of its own."""
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    key = F.struct("place", F.xxhash64("role", "formatted").alias("hash"))
    once = linked.where(whole).groupBy("conv_id", "thread", "place", "role", "formatted").agg(F.lit(1).cast("long").alias("one"))
    at = running(once.withColumn("key", key), ["conv_id", "thread"], "key", ["one"]).withColumn("part", F.floor((F.col("cum_one") - 1) / part).cast("long"))
    parts = at.groupBy("conv_id", "thread", "part").agg(F.sort_array(F.collect_list(F.struct("cum_one", "formatted"))).alias("m"))  # ``part`` messages at most
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    return parts.select("conv_id", "thread", "part", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda x: x["formatted"]), "").alias("text")) \
        .unionByName(linked.where(~whole).select("conv_id", "thread", zero.alias("part"), one.alias("n_messages"), F.col("formatted").alias("text")))
