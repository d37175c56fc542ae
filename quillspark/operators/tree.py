"""Ordered trees as tables: one row a node, ``node_order`` its place in preorder, ``path`` the orders from the root to itself.

Everything is by paper, so all shuffles hash ``paper_id``, and a paper is as large as a document. Ancestors come
from exploding ``path``; descendants are ``node_order BETWEEN node_order AND subtree_end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import TokenCounter, count_tokens

#: Rank of each section macro.
SECTION_RANKS = {"part": 0, "chapter": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
#: Environments that become nodes.
BLOCKS = ["equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "figure", "figure*", "table", "table*", "theorem", "proof", "definition", "lemma", "proposition", "corollary", "thebibliography"]


def parents(rows: DataFrame, key: str = "paper_id", order: str = "node_order", rank: str = "rank") -> DataFrame:
    """Adds ``parent_order``, ``path`` and ``depth`` in one window pass, without a stack and without joins.

    rank: null for leaves and for the first row of a paper, its root. The last row of each rank so far is open
    if no row of a lower rank came after it; the open ones below the own rank are the ancestors, and the parent
    of a row is the nearest of them, else the root.
    """
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    ranks = sorted(set(SECTION_RANKS.values()))
    last = {k: f"_last{k}" for k in ranks}
    out = rows.withColumns({last[k]: F.last(F.when(F.col(rank) == k, F.col(order)), ignorenulls=True).over(before) for k in ranks} | {"_root": F.first(order).over(before)})
    above = F.array(F.col("_root"))
    for i, k in enumerate(ranks):
        closing = [F.col(last[j]) for j in ranks[:i]]
        after = F.lit(True) if not closing else F.col(last[k]) > F.coalesce(F.greatest(*closing, F.lit(-1)) if len(closing) > 1 else closing[0], F.lit(-1))
        is_open = F.col(last[k]).isNotNull() & after & (F.col(rank).isNull() | (F.col(rank) > k))
        above = F.concat(above, F.when(is_open, F.array(F.col(last[k]))).otherwise(F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>")))
    path = F.when(F.col("_root").isNull(), F.array(order)).otherwise(F.concat(above, F.array(order)))
    out = out.withColumn("path", path).withColumn("depth", F.size("path") - 1).withColumn("parent_order", F.when(F.col("depth") > 0, F.element_at("path", -2)).cast("int"))
    return out.drop("_root", *last.values())


def ancestors(nodes: DataFrame, *columns: str) -> DataFrame:
    """A row for each node and ancestor-or-self: ``paper_id, node_order, anc_order, anc_depth`` and the columns."""
    return nodes.select("paper_id", "node_order", *columns, F.posexplode("path").alias("anc_depth", "anc_order"))


def subtree_ends(nodes: DataFrame) -> DataFrame:
    ends = ancestors(nodes).groupBy("paper_id", F.col("anc_order").alias("node_order")).agg(F.max("node_order").alias("subtree_end"))
    return nodes.join(ends, ["paper_id", "node_order"])


def in_paper(condition: Column) -> Column:
    """Orders of the paper's rows that meet the condition; a paper is as large as a document."""
    return F.collect_set(F.when(condition, F.col("node_order"))).over(Window.partitionBy("paper_id"))


def with_excluded_depth(nodes: DataFrame) -> DataFrame:
    """Adds ``last_excluded``: depth of the deepest excluded node on the path, -1 without, and ``first_excluded``."""
    out = nodes.withColumn("_x", in_paper(F.col("include_status") == "exclude"))
    hit = F.filter(F.transform("path", lambda o, i: F.when(F.array_contains("_x", o), i)), lambda i: i.isNotNull())
    out = out.withColumn("_x", hit)
    return out.withColumns({"last_excluded": F.coalesce(F.array_max("_x"), F.lit(-1)), "first_excluded": F.coalesce(F.array_min("_x"), F.lit(-1))}).drop("_x")


def totals(nodes: DataFrame) -> DataFrame:
    """Adds ``token_count``: a leaf's own; else the sum of the leaves below that no node in between excludes."""
    flagged = with_excluded_depth(nodes)
    given = ancestors(flagged.where("is_leaf"), "own_tokens", "last_excluded").where("last_excluded <= anc_depth")
    sums = given.where("anc_order <> node_order").groupBy("paper_id", F.col("anc_order").alias("node_order")).agg(F.sum("own_tokens").alias("_sum"))
    out = flagged.join(sums, ["paper_id", "node_order"], "left")
    return out.withColumn("token_count", F.when(F.col("is_leaf"), F.col("own_tokens")).otherwise(F.coalesce("_sum", F.lit(0)))).drop("_sum")


def excluded(nodes: DataFrame) -> Column:
    return nodes["first_excluded"] >= 0


def front_matter(nodes: DataFrame) -> DataFrame:
    """Excludes prose directly under the root of papers with parts, chapters or sections there."""
    top = F.col("depth") == 1
    sections = F.max(F.when(top, F.col("node_type").isin("part", "chapter", "section")).otherwise(False)).over(Window.partitionBy("paper_id"))
    drop = top & (F.col("node_type") == "paragraph") & sections
    return nodes.withColumn("include_status", F.when(drop, F.lit("exclude")).otherwise(F.col("include_status")))


def apply_states(nodes: DataFrame, states: DataFrame) -> DataFrame:
    """Saved ``include_status`` and ``digest_mode`` over the nodes; states without a node are ignored."""
    s = states.select("paper_id", "node_order", F.col("include_status").alias("_i"), F.col("digest_mode").alias("_d"))
    out = nodes.join(s, ["paper_id", "node_order"], "left")
    return out.withColumns({"include_status": F.coalesce("_i", "include_status"), "digest_mode": F.coalesce("_d", "digest_mode")}).drop("_i", "_d")


#: What the planner's keys do to a node.
EDITS = {"include": ("include", None), "exclude": ("exclude", None), "bundle": (None, "whole"), "split": (None, "split"), "auto": (None, "auto")}


def apply_edits(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: ``paper_id, node_order, edit`` (names of EDITS) in order ``seq``; the last of either kind holds."""
    status = F.when(F.col("edit").isin("include", "exclude"), F.col("edit"))
    mode = F.when(F.col("edit") == "bundle", "whole").when(F.col("edit").isin("split", "auto"), F.col("edit"))
    last = edits.groupBy("paper_id", "node_order").agg(F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("include_status"), F.max_by(mode, F.when(mode.isNotNull(), F.col("seq"))).alias("digest_mode"))
    return apply_states(nodes, last)


def states(nodes: DataFrame) -> DataFrame:
    return nodes.select("paper_id", "node_order", "include_status", "digest_mode")


def visible_rows(nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """Rows of the planner: nodes whose ancestors are all expanded, with the nearest bundling and excluding ancestor.

    expanded: ``paper_id, node_order``.
    """
    up = nodes.select("paper_id", F.col("node_order").alias("anc_order"), F.col("digest_mode").alias("_mode"), F.col("include_status").alias("_status"))
    opened = expanded.select("paper_id", F.col("node_order").alias("anc_order"), F.lit(True).alias("_open"))
    above = ancestors(nodes).where("anc_order <> node_order").join(up, ["paper_id", "anc_order"]).join(opened, ["paper_id", "anc_order"], "left")
    found = above.groupBy("paper_id", "node_order").agg(
        F.max(F.when(F.col("_mode") == "whole", F.col("anc_order"))).alias("bundled_by"),
        F.max(F.when(F.col("_status") == "exclude", F.col("anc_order"))).alias("excluded_by"),
        F.bool_and(F.coalesce("_open", F.lit(False))).alias("_shown"),
    )
    out = nodes.join(found, ["paper_id", "node_order"], "left").where(F.coalesce("_shown", F.lit(True))).drop("_shown")
    own = F.col("include_status") == "exclude"
    shown = F.when(own, "exc").when(F.col("excluded_by").isNotNull(), "in-exc").otherwise("inc")
    mode = F.when(F.col("bundled_by").isNotNull(), "in-bndl").when(F.col("digest_mode") == "whole", "bundle").otherwise(F.col("digest_mode"))
    return out.withColumns({"display_status": shown, "display_mode": mode})


def labelled(nodes: DataFrame) -> DataFrame:
    """Adds ``label``, ``heading`` and ``model_text``."""
    out = nodes.withColumn("label", T.display_label(F.col("title"), F.col("caption"), F.col("text")))
    out = out.withColumn("heading", T.heading(F.col("node_order"), F.col("node_type"), F.col("title"), F.col("label")))
    return out.withColumn("model_text", T.model_text(F.col("caption"), F.col("image_paths"), F.col("text")))


def selected_leaves(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """``paper_id, unit_order`` and the columns of each included leaf of the unit's subtree."""
    flagged = with_excluded_depth(nodes).where("is_leaf")
    # a unit is an ancestor-or-self of its leaves: an equi-join on the path instead of a range join
    pairs = flagged.select("*", F.posexplode("path").alias("_unit_depth", "unit_order")).where("last_excluded < _unit_depth")
    return pairs.join(units.select("paper_id", F.col("node_order").alias("unit_order")), ["paper_id", "unit_order"]).drop("_unit_depth", "last_excluded", "first_excluded")


def chunk_texts(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """``paper_id, node_order, chunk_text``: a unit's heading, then its selected leaves with theirs, blank lines between."""
    named = labelled(nodes)
    part = F.array_join(F.concat(F.array(F.lit("")), F.filter(F.array("heading", "model_text"), lambda x: x != "")), "\n")
    leaves = selected_leaves(named, units.select("paper_id", "node_order")).where("node_order <> unit_order")
    body = leaves.groupBy("paper_id", F.col("unit_order").alias("node_order")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_order").alias("o"), part.alias("t")))).alias("_parts"))
    own = named.join(units.select("paper_id", "node_order"), ["paper_id", "node_order"]).join(body, ["paper_id", "node_order"], "left")
    bare = T.selectable_text(F.col("node_type"), F.col("title"), F.col("caption"), F.col("image_paths"), F.col("text"))
    empty = F.when(F.col("is_leaf"), F.col("model_text")).otherwise(bare)
    whole = F.array_join(F.concat(F.array("heading"), F.col("_parts.t")), "\n")
    alone = F.array_join(F.concat(F.array("heading"), F.filter(F.array(empty), lambda x: x != "")), "\n")
    return own.select("paper_id", "node_order", F.when(F.col("_parts").isNotNull(), whole).otherwise(alone).alias("chunk_text"))


def chunk_images(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """``paper_id, node_order, images``: distinct paths of all included nodes of a unit (inner ones too), first seen first."""
    flagged = with_excluded_depth(nodes)
    pairs = ancestors(flagged, "image_paths", "last_excluded").join(units.select("paper_id", F.col("node_order").alias("anc_order")), ["paper_id", "anc_order"]).where("last_excluded < anc_depth")
    rows = pairs.where(F.size("image_paths") > 0).groupBy("paper_id", F.col("anc_order").alias("node_order")).agg(F.array_sort(F.collect_list(F.struct(F.col("node_order").alias("o"), "image_paths"))).alias("x"))
    return rows.select("paper_id", "node_order", T.first_seen(F.flatten(F.col("x.image_paths"))).alias("images"))


def with_tokens(nodes: DataFrame, counter: TokenCounter = count_tokens) -> DataFrame:
    """Adds ``own_tokens`` of leaves, counted over their selectable text."""
    return nodes.withColumn("own_tokens", F.when(F.col("is_leaf"), counter(T.selectable_text(F.col("node_type"), F.col("title"), F.col("caption"), F.col("image_paths"), F.col("text")))).otherwise(F.lit(0).cast("long")))
