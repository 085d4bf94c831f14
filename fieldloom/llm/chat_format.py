"""Chat formatting of reply trees, with DataFrame functions only.

Messages (tree, node, parent, role, text, score) form trees. Self-joins that double the step each time
find every message's root, depth and path score; each tree's leaves are ranked by the mean score of
their root-to-leaf path (ties: the smaller leaf), and the chosen paths are enumerated by the same
doubling joins, so a path of n messages takes about log2(n) joins. Each path becomes one conversation.

Template: `### role: text</turn>` and a newline for each turn. Inside roles and texts a backslash
becomes `\\\\`, `###` becomes `\\h`, `</turn>` becomes `\\e`, and inside roles `:` becomes `\\c`; so control strings
never occur in them, and `unescape` gives back what was there. `loss_spans` has the places of the
trained texts, in code points.

Cases: null texts and roles are empty; a message whose parent is missing is a root; messages on a
cycle have no root and are left out; a null tree is one tree; of several messages with one tree and node the least by
parent, role, text and score counts; a message with a null node is no message; a null score is 0, and equal mean scores go to the smaller
leaf; rows of a conversation with the same turn go by role and text;
a null turn comes first; a null conv_id is one conversation; repeated rows are turns of their own;
extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

#: Fixed: the template's control strings.
HEAD, COLON, TAIL = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
CONTROL = r"\### Assistant: </turn> ok"


def _replace(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column, role: bool = False) -> Column:
    c = _replace(F.coalesce(c, F.lit("")), ("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\e"))
    return _replace(c, (":", "\\c")) if role else c


def unescape(c: Column) -> Column:
    """Backslashes left after pairs are taken out, from the left, begin escapes."""
    parts = F.transform(F.split(c, r"\\\\"), lambda x: _replace(x, ("\\h", "###"), ("\\e", "</turn>"), ("\\c", ":")))
    return F.array_join(parts, "\\")


def doubled(messages: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node, depth, total) of all messages that have a root; and for each k the pairs (tree, node, up) of a message and the one 2**k above it."""
    parents = messages.select("tree", F.col("node").alias("up"), F.lit(True).alias("there"))
    state = messages.select("tree", "node", F.col("parent").alias("up"), "score").join(parents, ["tree", "up"], "left")
    state = state.select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    state, jumps, open_before = common.checkpoint(state), [], None
    n = state.count()
    while True:
        unfinished = state.where("up IS NOT NULL").count()
        if not unfinished or 2 ** len(jumps) > n:
            return state.where("up IS NULL").select("tree", "node", "depth", "total"), jumps
        jumps.append(state.where("up IS NOT NULL").select("tree", "node", "up"))
        above = state.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # Only messages that have not reached their root are joined; the others are carried over.
        moved = state.where("up IS NOT NULL").join(above, ["tree", "up"], "left").select(
            "tree",
            "node",
            F.col("up2").alias("up"),
            (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
        )
        state = common.checkpoint(state.where("up IS NULL").select(moved.columns).unionByName(moved))


def chosen_paths(messages: DataFrame, n_paths: int | None = 1) -> DataFrame:
    """(tree, leaf, place, node): the messages of the best paths of each tree, places from 1 at the root."""
    known, jumps = doubled(messages)
    inner = messages.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = known.join(inner, ["tree", "node"], "left_anti").withColumn("mean", F.col("total") / F.col("depth"))
    if n_paths == 1:  # a grouped maximum: no tree's leaves meet in one task
        best = leaves.groupBy("tree").agg(F.max(F.struct("mean", (-F.col("node")).alias("minus"), "depth")).alias("b"))
        leaves = best.select("tree", (-F.col("b.minus")).alias("leaf"), "b.depth")
    else:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "node"))
        leaves = leaves if n_paths is None else leaves.withColumn("r", rank).where(F.col("r") <= n_paths)
        leaves = leaves.select("tree", F.col("node").alias("leaf"), "depth")
    path = leaves.select("tree", "leaf", F.col("depth").alias("place"), F.col("leaf").alias("node"))
    for k in reversed(range(len(jumps))):
        above = path.join(jumps[k], ["tree", "node"]).select("tree", "leaf", (F.col("place") - 2**k).alias("place"), F.col("up").alias("node"))
        path = common.checkpoint(path.unionByName(above))
    return path


def format_trees(messages: DataFrame, n_paths: int | None = 1, trained: str = TRAINED) -> DataFrame:
    """(tree, leaf, formatted, loss_spans), one row for each chosen path, of any messages."""
    rest = F.struct(F.col("parent").cast("long").alias("parent"), F.col("role").alias("role"), F.col("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = messages.where("node IS NOT NULL").select(F.struct("tree").alias("tree"), F.col("node").cast("long").alias("node"), rest.alias("m"))
    one = common.checkpoint(rows.groupBy("tree", "node").agg(F.min("m").alias("m")).select("tree", "node", "m.*"))
    return format_known(one, n_paths, trained).withColumn("tree", F.col("tree.tree"))


def format_known(messages: DataFrame, n_paths: int | None = 1, trained: str = TRAINED) -> DataFrame:
    """format_trees of messages whose tree, node and score are not null and whose (tree, node) are unique."""
    path = chosen_paths(messages, n_paths).join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    before = F.concat(F.lit(HEAD), escape(F.col("role"), role=True), F.lit(COLON))
    turns = path.select("tree", "leaf", "place", (F.col("role") == trained).alias("own"), before.alias("before"), escape(F.col("text")).alias("body"))
    turns = turns.select("tree", "leaf", "place", "own", F.char_length("before").alias("skip"), F.char_length("body").alias("n"), F.concat("before", "body", F.lit(TAIL)).alias("piece"))
    to_here = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.char_length("piece")).over(to_here), F.lit(0)) + F.col("skip"))
    rows = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct("place", "piece", "own", "start", "n"))).alias("t"))
    own = F.transform(F.filter("t", lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("length")))
    return rows.select("tree", "leaf", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), own.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted conversation."""
    turns = F.filter(F.split(formatted, TAIL), lambda x: x != "")

    def turn(x):
        body = F.substr(x, F.lit(len(HEAD) + 1))
        at = F.instr(body, COLON)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1)).alias("role"), unescape(F.substr(body, at + len(COLON))).alias("text"))

    return F.transform(turns, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """What the output says, read back from it."""
    df = formatted.select("*", parse(F.col("formatted")).alias("turns"))
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    df = df.select("*", F.array_join(loss, "").alias("loss"), F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"))
    return df.select(
        "tree",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("said", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def chains(conversations: DataFrame) -> DataFrame:
    """Conversations as trees without branches: each turn replies to the one before."""
    df = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")).alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("node", F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long"))
    return df.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"), F.lit(CONTROL).alias("text"))
    found = digests(format_known(chains(rows.unionByName(more))))
    return found.select(F.when(F.col("tree") != "null", F.col("tree")).cast("long").alias("conv_id"), "*").drop("tree")


QUERIES = {"op1_chat_format": op1_chat_format}
ORACLE_SQL = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
e AS (
  SELECT *, length('### : </turn>' || chr(10)) + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'))
    + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e')) AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
}
