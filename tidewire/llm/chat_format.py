r"""Reply trees to formatted conversations.

A message has a tree, an id, a parent id (null at a root), a role, a text and a score.
Iterative self-joins over (id, ancestor) pairs double the reach of each pair, so a tree
of depth d needs about log2(d) rounds; they give every message its depth and the score
of its branch (the sum of scores from the root).  The leaves of a tree are ranked by
that score and the chosen ones expanded, again by doubling, to their root-to-leaf paths.
Each path becomes one conversation:

    <s>role[INST]text[/INST]</s>\n       for each turn

Control strings inside roles and texts are escaped reversibly: backslashes are doubled,
then one is put after the first character of each control string.  ``loss_spans`` gives
the code-point spans of the escaped assistant texts.

Null roles and texts count as empty.  Of messages that repeat a (tree, id) one stays, by best
score, then largest parent, role and text; messages with a null id are left out; a null tree
is a tree like any other; an empty table gives an empty result; extra columns are ignored.  A parent that is not in the tree makes a root.
Messages on a cycle never reach a root and are left out.  Ties of the branch score go to
the larger leaf id, ties of ids are broken by role and text in :func:`turns_as_tree`.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.components import written

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURN = r"(?s)<s>(.*?)\[INST\](.*?)\[/INST\]</s>"


def escape(c: Column) -> Column:
    c = F.regexp_replace(c, r"\\", r"\\\\")
    heads = "|".join(f"(?<={re.escape(x[0])})(?={re.escape(x[1:])})" for x in CONTROLS)
    return F.regexp_replace(c, heads, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(\\?)", "$1")


def turns_as_tree(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as a reply tree in which each row answers the one before."""
    order = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("id", F.row_number().over(order).cast("bigint"))
    return rows.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Pairs (tree, id, up) at distances 1, 2, 4, ...; and for each message its depth,
    branch score and whether it reached a root.  Only messages that haven't reached their
    root go through the next round."""
    own = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    there = own.select("tree", F.col("id").alias("parent"), F.lit(True).alias("has"))
    asked = own.filter("parent IS NOT NULL").join(there, ["tree", "parent"], "left")
    start = asked.select("tree", "id", F.when(F.col("has"), F.col("parent")).alias("up"), "score").unionByName(own.filter("parent IS NULL").select("tree", "id", F.lit(None).cast("bigint").alias("up"), "score"))
    state = written(start.withColumn("depth", F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint")))
    most = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while True:
        under = state.filter("up IS NOT NULL")
        level = under.select("tree", "id", "up")
        if level.isEmpty():
            return levels, state
        levels.append(level)
        if (1 << (len(levels) - 1)) > most:  # only cycles are left
            return levels, state.filter("up IS NULL")
        above = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("score").alias("score2"))
        moved = under.join(above, ["tree", "up"]).select("tree", "id", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("score") + F.col("score2")).alias("score"))
        state = written(state.filter("up IS NULL").unionByName(moved))


def _unique(messages: DataFrame) -> DataFrame:
    """One message for each (tree, id): of repeated ones that with the best score, then the largest parent, role and text."""
    best = messages.groupBy("tree", "id").agg(F.max(F.struct("score", "parent", "role", "text")).alias("m"))
    return best.filter("id IS NOT NULL").select("tree", "id", "m.parent", "m.role", "m.text", "m.score")


def _keyed(messages: DataFrame) -> DataFrame:
    """The tree in a struct: joins match structs whose field is null, so a null tree is one like any other."""
    return messages.withColumn("tree", F.struct(F.col("tree").alias("of")))


def _unkeyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tree", F.col("tree")["of"])


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, id, depth) rows of the ``branches`` best root-to-leaf paths of each tree."""
    return _unkeyed(_paths(_unique(_keyed(messages)), branches))


def _paths(messages: DataFrame, branches: int) -> DataFrame:
    levels, state = _jumps(messages)
    parents = messages.select("tree", F.col("parent").alias("id")).filter("id IS NOT NULL").distinct()
    leaves = state.join(parents, ["tree", "id"], "left_anti")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("id"))))
    paths = ranked.filter(F.col("rank") <= branches).select("tree", F.col("id").alias("leaf"), "rank", "id")
    for level in reversed(levels):  # each round reads the paths twice, so its lineage is cut
        paths = written(paths.unionByName(paths.join(level, ["tree", "id"]).select("tree", "leaf", "rank", F.col("up").alias("id"))))
    return paths.join(state.select("tree", "id", "depth"), ["tree", "id"])


def format_trees(messages: DataFrame, branches: int = 1, unique_ids: bool = False) -> DataFrame:
    """One row per chosen path: tree, leaf, rank, n_turns, formatted, loss_spans.

    ``unique_ids`` says that no (tree, id) is repeated or null, as :func:`turns_as_tree` sees to.
    """
    messages = _keyed(messages) if unique_ids else _unique(_keyed(messages))
    paths = _paths(messages, branches)
    turns = paths.join(messages.select("tree", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["tree", "id"])
    head = F.concat(F.lit("<s>"), escape(F.col("role")), F.lit("[INST]"))
    turns = turns.select("tree", "leaf", "rank", F.struct("depth", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")).alias("turn"))
    convs = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    tail = "[/INST]</s>\n"
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.char_length(t["head"]) + F.char_length(t["body"]) + F.lit(len(tail))).alias("at"),
            F.when(t["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.char_length(t["head"])).alias("start"), F.char_length(t["body"]).cast("bigint").alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(tail))), "")
    return _unkeyed(convs).select("tree", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"), text.alias("formatted"), ends["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) read from a formatted conversation."""
    roles, texts = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(k)) for k in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
