"""Chat formatting of reply trees: root-to-leaf paths by iterative self-joins, the best branches formatted as conversations.

Nodes are (tree, node, parent, role, text, score). Every node's pointer to an ancestor is joined with that ancestor's own
pointer, so that it reaches twice as far each round; depth and summed score come along, and after log2(depth) rounds all
have met their root. Leaves are ranked by the score of their path, and the chosen ones climb back by the pointers of all
rounds, so that a path of n nodes takes log2(n) joins and no task holds one. Paths are formatted in parts of bounded length:
where a turn stands in its conversation comes from sums of the parts before it. Functions and joins only, no Python.

A turn is ``<|im_start|>role<|im_sep|>text<|im_end|>``. Within roles and texts a backslash is doubled and any control string,
of this template or of other common ones, has a backslash after its first character, so no text can forge a turn and
``unescape`` gives it back unchanged.

Defined results: null texts and roles are empty, null scores 0; a parent that isn't there makes its child a root; nodes
whose ancestors run in a circle are on no path; null trees are one tree; nodes must differ within a tree (``chain`` numbers
rows, repeated ones and ties too); of equal scores the deeper leaf, then the smaller node comes first; an empty table gives
no rows; other columns are never looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

OPEN, SEP, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings that no text may contain once it is formatted.
CONTROL = [OPEN, SEP, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Turns of a part.
PART = 256
#: Width of the ranges of turn in which rows are numbered.
RANGE = 1024
_CONTROL = "(?=" + "|".join(re.sub(r"([\[\]|])", r"\\\1", c) for c in CONTROL) + ")(.)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame) -> DataFrame:
    """Rows (tree, turn, role, text) as a tree without branches: each replies to the one before it by turn, nulls first, then
    role and text. Numbers are counts of the ranges of turn before, and places within the own one."""
    at = F.floor(F.col("turn") / RANGE).alias("r")
    rows = rows.select(F.struct("tree").alias("t"), "turn", "role", "text", at)  # structs, so that null trees compare
    sizes = rows.groupBy("t", "r").agg(F.count("*").alias("n"))
    before = sizes.select("t", F.coalesce("r", F.lit(-(1 << 62))).alias("r"), (F.sum("n").over(Window.partitionBy("t").orderBy("r")) - F.col("n")).alias("base"))  # a row a range
    own = rows.withColumn("r", F.coalesce("r", F.lit(-(1 << 62)))).withColumn("k", F.row_number().over(Window.partitionBy("t", "r").orderBy("turn", "role", "text")) - 1)
    node = F.col("base") + F.col("k")
    return own.join(before, ["t", "r"]).select("t.tree", node.alias("node"), F.when(node > 0, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """t (struct of tree), branch (from 1), place (from 0), node: the nodes of each tree's best root-to-leaf paths."""
    own = nodes.select(F.struct("tree").alias("t"), "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    there = own.select(F.col("t").alias("t2"), F.col("node").alias("up"))
    first = own.join(there, (F.col("t") == F.col("t2")) & (F.col("parent") == F.col("up")), "left")
    now = written(first.select("t", "node", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.col("score").alias("total")))
    levels, most = [], now.count().bit_length() + 1
    while len(levels) < most and not now.where("up is not null").isEmpty():
        levels.append(now.where("up is not null").select("t", "node", "up"))
        on = now.select(F.col("t").alias("t2"), F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("s2"))
        far = now.where("up is not null").join(on, (F.col("t") == F.col("t2")) & (F.col("up") == F.col("n2")))
        now = written(far.select("t", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("s2")).alias("total")).unionAll(now.where("up is null")))
    replied = own.where("parent is not null").select(F.col("t").alias("t2"), F.col("parent").alias("p2")).distinct()
    leaves = now.where("up is null").join(replied, (F.col("t") == F.col("t2")) & (F.col("node") == F.col("p2")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("total"), F.desc("depth"), "node"))
    chosen = written(leaves.withColumn("branch", rank).where(F.col("branch") <= branches).select("t", "branch", F.col("depth").alias("place"), "node"))
    for k, level in enumerate(levels):
        # after this all ancestors nearer than 2 ** (k + 1) are there, each once
        to = level.select(F.col("t").alias("t2"), F.col("node").alias("n2"), "up")
        climbed = chosen.join(to, (F.col("t") == F.col("t2")) & (F.col("node") == F.col("n2"))).select("t", "branch", (F.col("place") - (1 << k)).alias("place"), F.col("up").alias("node"))
        chosen = written(chosen.unionAll(climbed))
    return chosen


def formatted(nodes: DataFrame, branches: int = 1, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """tree, branch, part, text, offset, loss: each chosen path in parts of PART turns, to be put together by part.

    offset is where the part starts in its conversation, loss the spans (start, length) of the conversation that a model
    learns from: the escaped texts of the roles ``loss``. All are in code points.
    """
    where = paths(nodes, branches).select("branch", "place", F.col("t").alias("t2"), F.col("node").alias("n2"))
    texts = nodes.select(F.struct("tree").alias("t"), "node", F.coalesce("role", F.lit("")).alias("role"), "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SEP))
    turns = texts.join(where, (F.col("t") == F.col("t2")) & (F.col("node") == F.col("n2"))).select(
        "t", "branch", "place", F.floor(F.col("place") / PART).alias("part"), head.alias("head"), escape(F.col("text")).alias("body"), F.col("role").isin(*loss).alias("learnt")
    )
    own = F.array_sort(F.collect_list(F.struct("place", "head", "body", "learnt")))
    parts = turns.groupBy("t", "branch", "part").agg(own.alias("x"))
    text = F.array_join(F.transform("x", lambda s: F.concat(s["head"], s["body"], F.lit(CLOSE))), "")
    # where texts start within the part: PART steps at most
    step = lambda a, s: F.struct((a["at"] + F.length(s["head"]) + F.length(s["body"]) + len(CLOSE)).cast("long").alias("at"), F.when(s["learnt"], F.array_append(a["spans"], F.struct((a["at"] + F.length(s["head"])).cast("long").alias("start"), F.length(s["body"]).cast("long").alias("length")))).otherwise(a["spans"]).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, length: bigint>>").alias("spans"))
    made = parts.select("t", "branch", "part", text.alias("text"), F.aggregate("x", start, step).alias("a"))
    before = F.sum("a.at").over(Window.partitionBy("t", "branch").orderBy("part")) - F.col("a.at")
    lengths = made.select("t", "branch", "part", "text", "a.spans", before.alias("offset"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), s["length"].alias("length")))
    return lengths.select(F.col("t.tree").alias("tree"), "branch", "part", "text", "offset", moved.alias("loss"))


def turns_of(text: Column) -> Column:
    """The turns (role, text) that a formatted text holds, unescaped."""
    pieces = F.filter(F.split(text, re.sub(r"([|])", r"\\\1", CLOSE), -1), lambda p: p != "")
    inner = F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, 1 << 30), re.sub(r"([|])", r"\\\1", SEP), -1))
    return F.transform(inner, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_back(parts: DataFrame) -> DataFrame:
    """tree, branch, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from formatted text and loss spans alone."""
    said = F.array_join(F.transform(turns_of(F.col("text")), lambda s: F.concat(s["role"], F.lit("\n"), s["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr("text", (s["start"] - F.col("offset") + 1).cast("int"), s["length"].cast("int")))), "")
    read = parts.select(F.struct("tree").alias("t"), "branch", "part", F.size(turns_of(F.col("text"))).alias("n"), said.alias("said"), learnt.alias("learnt"), F.length("text").alias("chars"))
    whole = read.groupBy("t", "branch").agg(F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("part", "said", "learnt"))).alias("x"), F.sum(F.length("learnt")).alias("loss_chars"), F.sum("chars").alias("formatted_chars"))
    digest = lambda f: F.sha2(F.array_join(F.transform("x", lambda s: s[f]), ""), 256)
    return whole.select(F.col("t.tree").alias("tree"), "branch", "n_turns", digest("said").alias("turns_sha256"), "loss_chars", digest("learnt").alias("loss_sha256"), "formatted_chars")


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and the stated one that says control strings, formatted and read back."""
    says = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").alias("tree"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast(rows.schema["tree"].dataType).alias("tree"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    nodes = written(chain(rows.unionByName(probe)))
    return read_back(formatted(nodes)).select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def query(spark, sf_dir):
    return report(table(spark, sf_dir, "conversations"))




_ESCAPES = " + ".join([f"length({{0}}) - length(replace({{0}}, '{c}', ''))" if len(c) == 1 else f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ["\\", *CONTROL]])
_ORDER = "ORDER BY turn NULLS FIRST, role, text"
ORACLE = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + SEP + CLOSE)} + length(role) + length(text) + {_ESCAPES.format("role")} + {_ESCAPES.format("text")}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
