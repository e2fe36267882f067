"""Chat formatting: reply trees to training conversations, by self-joins and functions of Spark alone.

A message is a node with at most one parent. Paths from a root to a leaf are found by self-joins that double the distance each time,
so that a thread of n messages takes log2(n) of them, on ids only: texts are joined to the paths that were chosen.

Template: a turn is ``### role``, a line feed, the text, ``</turn>``, a line feed. In roles and texts a backslash is doubled, ``##`` becomes
``#\\#`` and ``</turn>`` becomes ``<\\/turn>`` (in a role a line feed gets a backslash in front as well), so that neither a header nor an end
of a turn can occur in them, and a backslash always stands for the character behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fernlog.llm.common import discard, stored

#: Turns that are put together at once, before a conversation is.
BLOCK = 256
END = "</turn>\n"
_HEAD = r"^### ((?:[^\\\n]++|\\[\s\S])*+)\n"


def escape(col: Column) -> Column:
    """A text in which no control string of the template occurs; a null text is an empty one."""
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(col: Column) -> Column:
    return F.regexp_replace(col, r"\\([\s\S])", "$1")


def paths(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Root-to-leaf paths of reply trees: tree, path (its leaf's id), rank, score, turns, node, depth (0 for the root).

    ``messages`` has tree, id, parent_id and score; ids are unique in all trees. A message whose parent is null or isn't there is a root. A path's score
    is the mean over its messages (null counts as 0); paths of a tree are ranked by score, then by leaf, and ``branches`` is how many
    of a tree are returned (None: all). Messages that answer each other in a circle, and those below them, lie on no path from a root and
    are left out; so are messages with a null id. An empty table gives an empty one.

    Each round joins what every message knows (its ancestor so far, the distance, the sum of scores in between) with what that ancestor
    knows. A message with very many answers is a hot key of one side only, which adaptive execution splits.
    """
    own = messages.where(F.col("id").isNotNull()).select(F.col("tree"), F.col("id"), F.col("parent_id").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("sum"))
    there = own.select(F.col("id").alias("up"), F.lit(True).alias("found"))
    first = own.join(there, "up", "left").select("tree", "id", F.when(F.col("found"), F.col("up")).alias("up"), "sum")
    steps = [stored(first.withColumn("distance", F.col("up").isNotNull().cast("long")), "steps-0")]
    most = steps[0].count()
    while 2 ** (len(steps) - 1) < most and not steps[-1].where("up IS NOT NULL").isEmpty():
        low, high = steps[-1], steps[-1].select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("sum").alias("_sum"), F.col("distance").alias("_distance"))
        # who has arrived needs no join
        moved = low.where("up IS NOT NULL").join(high, F.col("up") == F.col("_id")).select("tree", "id", F.col("_up").alias("up"), (F.col("sum") + F.col("_sum")).alias("sum"), (F.col("distance") + F.col("_distance")).alias("distance"))
        steps.append(stored(low.where("up IS NULL").unionByName(moved), f"steps-{len(steps)}"))
    parents = steps[0].where("up IS NOT NULL").select(F.col("up").alias("id")).distinct()
    leaves = steps[-1].where("up IS NULL").join(parents, "id", "left_anti")
    leaves = leaves.select("tree", F.col("id").alias("path"), (F.col("sum") / (F.col("distance") + 1)).alias("score"), (F.col("distance") + 1).alias("turns"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "path"))
    chosen = leaves.withColumn("rank", place)
    chosen = stored(chosen if branches is None else chosen.where(F.col("rank") <= branches), "chosen")
    # distances 0 to 2^k - 1 above a leaf are known; the ancestors 2^k above those are the next ones
    known = [chosen.select("path", F.col("path").alias("node"), F.lit(0).cast("long").alias("above"))]
    for k, jump in enumerate(steps):
        so_far = known[0]
        for more in known[1:]:
            so_far = so_far.unionByName(more)
        jump = jump.where((F.col("up").isNotNull()) & (F.col("distance") == 2**k)).select(F.col("id").alias("node"), "up")
        new = stored(so_far.join(jump, "node").select("path", F.col("up").alias("node"), (F.col("above") + 2**k).alias("above")), "above")
        if new.isEmpty():
            break
        known.append(new)
    out = known[0]
    for more in known[1:]:
        out = out.unionByName(more)
    return out.join(chosen, "path").select("tree", "path", "rank", "score", "turns", "node", (F.col("turns") - 1 - F.col("above")).alias("depth"))


def format_paths(found: DataFrame, messages: DataFrame) -> DataFrame:
    """One conversation for each path of ``found`` (the rows of ``paths``): tree, path, rank, score, turns, formatted, segments.

    ``messages`` has id, role, text. ``segments`` are the parts of the formatted text, with ``loss`` true for the texts of
    assistants and false for everything else; neighbours that are both false are one. Texts are shuffled once to their paths and once to
    their conversations; there turns are put together in blocks of BLOCK, and then the blocks, so that what is sorted is short. A conversation
    is one row and must fit in it (2 GB).
    """
    role, text = escape(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit("### "), F.replace(role, F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    learns = F.coalesce(F.col("role") == "assistant", F.lit(False))
    turns = messages.select(F.col("id").alias("node"), head.alias("head"), text.alias("text"), learns.alias("loss"))
    rows = found.join(turns, "node").repartition("path")
    part = F.struct("depth", "head", "text", "loss")
    rows = rows.groupBy("path", F.floor(F.col("depth") / BLOCK).alias("block")).agg(*[F.first(c).alias(c) for c in ("tree", "rank", "score", "turns")], F.sort_array(F.collect_list(part)).alias("parts"))
    said = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    cut = F.transform("parts", lambda p: F.array(F.struct(p["head"].alias("text"), F.lit(False).alias("loss")), F.struct(p["text"].alias("text"), p["loss"].alias("loss")), F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    blocks = rows.select("tree", "path", "rank", "score", "turns", "block", said.alias("formatted"), F.flatten(cut).alias("segments"))
    one = blocks.groupBy("path").agg(*[F.first(c).alias(c) for c in ("tree", "rank", "score", "turns")], F.sort_array(F.collect_list(F.struct("block", "formatted", "segments"))).alias("blocks"))
    return one.select("tree", "path", "rank", "score", "turns", F.array_join(F.transform("blocks", lambda b: b["formatted"]), "").alias("formatted"), F.flatten(F.transform("blocks", lambda b: b["segments"])).alias("segments"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    pieces = F.split(formatted, F.lit("</turn>\n"))
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.regexp_extract(piece, _HEAD, 0)
        return F.struct(unescape(F.regexp_extract(piece, _HEAD, 1)).alias("role"), unescape(F.substr(piece, F.length(head) + 1)).alias("text"))

    return F.transform(whole, turn)


def digests(conversations: DataFrame) -> DataFrame:
    """What formatted conversations say, read back from them: ``conversations`` and n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = conversations.withColumns({"_turns": turns, "_learned": learned})
    return out.select(
        *conversations.columns, F.size("_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length("_learned").cast("long").alias("loss_chars"), F.sha2("_learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def threads(rows: DataFrame) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) as reply trees: tree, id, parent_id, role, text, score.

    Each row answers the row before it: by turn, null last, then role and text; rows that are alike in all of them follow each other.
    Rows with a null conv_id are one conversation. Rows are numbered by one distributed sort (ranges of rows, numbered in each, and the
    sizes of the ranges before), so that a conversation of any length needs no task of its own.
    """
    own = rows.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["tree", F.asc_nulls_last("turn"), F.asc_nulls_last("role"), F.asc_nulls_last("text")]
    placed = stored(own.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "threads")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each partition of the sort
    sizes = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    numbered = placed.join(F.broadcast(sizes), "_part").withColumn("id", F.col("_at") + F.col("_shift"))
    first = numbered.groupBy("tree").agg(F.min("id").alias("_least")).select(F.col("tree").alias("_tree"), "_least")
    starts = first.select(F.col("_least").alias("id"), F.lit(True).alias("_starts"))
    return numbered.join(starts, "id", "left").select("tree", "id", F.when(F.col("_starts").isNull(), F.col("id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Reply trees (tree, id, parent_id, role, text, score) as conversations, the ``branches`` best of each tree: the rows of ``format_paths``.

    Columns beside these are ignored. Null roles and texts count as empty.
    """
    held = stored(messages.select("tree", "id", "parent_id", "role", "text", "score"), "messages")
    return format_paths(paths(held, branches), held)


#: Digests of what the turns say, and the length of their formatted form.
ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, r)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST) AS place FROM c),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>') AS said,
    replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), chr(10), '\' || chr(10)) AS who FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(who) + 1 + length(said) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
