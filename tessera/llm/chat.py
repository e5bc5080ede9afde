"""Chat formatting by reply trees (native DataFrame operators only).

``format_trees`` takes message nodes (tree, node, parent, role, text, score), enumerates
the root-to-leaf paths of every tree by self-joins that double the covered distance in
each round, ranks a tree's branches by their summed score, and renders each chosen path as
one conversation with a loss mask over the assistant texts.

Template: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n`` for each turn.  Inside roles and texts
``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|`` (in roles a line feed also becomes
``<\\n|``), so that control strings in a text can neither open nor close a turn, and the
original is restored exactly by the inverse replacements.

Defined results: null texts and roles are empty strings; a null score counts 0; a null turn
comes first; rows with the same turn follow in the order of role, then text; a null tree id is one tree of its
own; a parent that does not exist makes its child a root; equal scores go to the branch
with the smaller leaf; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import durable

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n|"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def linear_nodes(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as nodes of one-branch trees; each turn answers the one before."""
    order = W.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(
        F.col("conv_id").alias("tree"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    node = F.row_number().over(order).cast("long") - 1
    return rows.select("tree", node.alias("node"), F.when(node > 0, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths: rows (tree, leaf, node, up), ``up`` the distance to the leaf.

    Round k knows the last 2^k nodes of every path and the 2^k-th ancestor of each node that
    has one; one self-join doubles both, so a path of d nodes takes log2(d) rounds, and
    nodes with fewer ancestors leave the rounds early.
    """
    kin = nodes.select("tree", "node", "parent")
    known = kin.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    same = F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("p"))
    jump = durable(kin.join(known, same).select("tree", "node", F.col("p").alias("to")))
    parents = jump.select(F.col("tree").alias("t"), F.col("to").alias("p")).distinct()
    leaves = kin.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step = 1
    while not jump.isEmpty():
        links = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "to")
        hit = F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))
        more = paths.join(links, hit).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        paths = durable(paths.unionByName(more))
        onward = links.select(F.col("t").alias("t2"), F.col("n").alias("n2"), F.col("to").alias("to2"))
        far = F.col("tree").eqNullSafe(F.col("t2")) & (F.col("to") == F.col("n2"))
        jump = durable(jump.join(onward, far).select("tree", "node", F.col("to2").alias("to")))
        step *= 2
        if step > 1 << 40:
            raise ValueError("the parents form a cycle")
    return paths


def render(chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, position, role, text) to one row per conversation: formatted, loss_spans.

    ``loss_spans`` are (start, end) code points of the escaped assistant texts.
    """
    turn = F.struct(
        "position", "role",
        F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    grouped = chosen.groupBy(*keys).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    sizes = F.transform("turns", lambda t: F.struct(
        F.length(t["head"]).cast("long").alias("head"), F.length(t["body"]).cast("long").alias("body"), (t["role"] == "assistant").alias("on")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + t["head"]
        end = begin + t["body"]
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(END) + 1).alias("at"), F.when(t["on"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select(*keys, whole.alias("formatted"), F.aggregate(sizes, start, add, lambda a: a["spans"]).alias("loss_spans"))


def format_trees(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Rows (tree, leaf, branch_rank, branch_score, formatted, loss_spans), the best ``branches`` per tree."""
    nodes = durable(nodes)
    paths = durable(tree_paths(nodes))
    # Branches are ranked by scores alone; texts are fetched for the chosen ones.
    scored = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("score", F.lit(0.0)).alias("score"))
    scores = paths.join(scored, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    best = W.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    scores = scores.withColumn("branch_rank", F.row_number().over(best)).filter(F.col("branch_rank") <= branches)
    kept = paths.alias("p").join(scores.alias("s"), F.col("p.tree").eqNullSafe(F.col("s.tree")) & (F.col("p.leaf") == F.col("s.leaf")))
    kept = kept.select("p.tree", "p.leaf", "p.node", "p.up", "s.branch_rank", "s.branch_score")
    kept = kept.alias("k").join(nodes.alias("n"), F.col("k.tree").eqNullSafe(F.col("n.tree")) & (F.col("k.node") == F.col("n.node")))
    kept = kept.select("k.tree", "k.leaf", "k.branch_rank", "k.branch_score", (-F.col("k.up")).alias("position"), "n.role", "n.text")
    return render(kept, ["tree", "leaf", "branch_rank", "branch_score"])


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) and ``loss_text`` parsed from formatted and loss_spans alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turns = F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring_index(F.substring(p, F.locate("\n", p) + 1, 1 << 30), END, 1)).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumn("turns", turns).withColumn("loss_text", F.array_join(masked, ""))
