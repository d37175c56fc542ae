"""Chunk plans: which nodes become units, under a token limit.

Every node decides for itself (stop, delegate, emit or error); a unit is a node that emits and whose proper
ancestors all delegate. That is one explode and one join by paper, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.budget import TokenBudget, default_level, level_of
from ..operators.tree import in_paper


def checked_limit(budget: TokenBudget) -> int:
    if budget.chunk_text_tokens <= 0:
        raise ValueError(f"the chunk text limit is {budget.chunk_text_tokens} tokens; it must be positive")
    return budget.chunk_text_tokens


def decisions(nodes: DataFrame, limit: int, target: str = "subsection") -> DataFrame:
    """Adds ``decision`` to nodes with totals."""
    level, tokens, mode = level_of(F.col("node_type")), F.col("token_count"), F.col("digest_mode")
    fits = tokens <= limit
    return nodes.withColumn(
        "decision",
        F.when(F.col("include_status") == "exclude", "stop")
        .when(F.col("node_type") == "paper", "delegate")
        .when((mode == "whole") & ~fits, "error")
        .when(mode == "whole", "emit")
        .when(F.col("is_leaf"), "emit")
        .when(mode == "split", "delegate")
        .when(((level == 0) | (level == default_level(target))) & fits, "emit")
        .otherwise("delegate"),
    )


def _with_reached(decided: DataFrame) -> DataFrame:
    """Adds ``reached``: all proper ancestors delegate."""
    out = decided.withColumn("_b", in_paper((F.col("decision") != "delegate") & ~F.col("is_leaf")))
    return out.withColumn("reached", ~F.arrays_overlap(F.slice("path", F.lit(1), F.col("depth")), "_b")).drop("_b")


def _reached(decided: DataFrame) -> DataFrame:
    return _with_reached(decided).where("reached").drop("reached")


def _numbered(emitted: DataFrame) -> DataFrame:
    return emitted.withColumn("chunk_index", F.row_number().over(Window.partitionBy("paper_id").orderBy("node_order")))


def units(decided: DataFrame) -> DataFrame:
    """Emitted nodes with ``chunk_index`` from 1. Nodes that fail are left to ``errors``."""
    return _numbered(_reached(decided).where("decision = 'emit'"))


def _message(limit: int) -> Column:
    return F.format_string("Node %04d was marked whole but has %d tokens, over the chunk text limit %d.", F.col("node_order"), F.col("token_count"), F.lit(limit))


def errors(decided: DataFrame, limit: int) -> DataFrame:
    """All nodes that make the plan fail, with the message; ``is_first`` marks the one that is met first."""
    out = _reached(decided).where("decision = 'error'")
    first = F.row_number().over(Window.partitionBy("paper_id").orderBy("node_order")) == 1
    return out.select("paper_id", "node_order", "token_count", _message(limit).alias("message"), first.alias("is_first"))


def outcomes(decided: DataFrame, limit: int) -> DataFrame:
    """Units and failures together: ``chunk_index`` of a unit, ``message`` of a node that fails, the other one null."""
    out = _reached(decided).where("decision IN ('emit', 'error')")
    good = F.col("decision") == "emit"
    index = F.when(good, F.sum(good.cast("int")).over(Window.partitionBy("paper_id").orderBy("node_order"))).cast("int")
    return out.withColumn("chunk_index", index).withColumn("message", F.when(~good, _message(limit)))


def counters(decided: DataFrame) -> DataFrame:
    """``paper_id, chunks, errors``: how many units a paper has, and how many nodes that fail."""
    of = lambda d: F.count_if(F.col("decision") == d)
    return _reached(decided).groupBy("paper_id").agg(of("emit").alias("chunks"), of("error").alias("errors"))


def plan(nodes: DataFrame, budget: TokenBudget | None = None, target: str = "subsection") -> DataFrame:
    """Units of nodes with totals; the query fails, with the message, where a whole node is over the limit."""
    limit = checked_limit(budget or TokenBudget())
    checked = _with_reached(decisions(nodes, limit, target))
    # one expression, so that a node is only asked for its decision where it is reached
    emitted = F.when(~F.col("reached"), F.lit(False)).when(F.col("decision") == "error", F.raise_error(_message(limit)).cast("boolean")).otherwise(F.col("decision") == "emit")
    return _numbered(checked.where(emitted).drop("reached"))


def validated(nodes: DataFrame, budget: TokenBudget | None = None, target: str = "subsection") -> tuple[DataFrame, DataFrame]:
    """The chunks of papers without errors, and all errors."""
    limit = checked_limit(budget or TokenBudget())
    decided = decisions(nodes, limit, target)
    bad = errors(decided, limit)
    return units(decided).join(bad.select("paper_id").distinct(), "paper_id", "left_anti"), bad


def top_level(nodes: DataFrame, skip_empty: bool = False) -> DataFrame:
    """Nodes with every included child of the root marked whole."""
    top = (F.col("depth") == 1) & (F.col("include_status") == "include")
    if skip_empty:
        top &= F.col("token_count") > 0
    return nodes.withColumn("digest_mode", F.when(top, "whole").otherwise(F.col("digest_mode")))


def chunk_records(planned: DataFrame) -> DataFrame:
    """Initial records of a run: ``paper_id, chunk_index, node_titles, node_types, node_orders, token_count, status``."""
    label = T.display_label(F.col("title"), F.col("caption"), F.col("text"))
    return planned.select("paper_id", "chunk_index", F.array(label).alias("node_titles"), F.array("node_type").alias("node_types"), F.array("node_order").alias("node_orders"), "token_count", F.lit("pending").alias("status"))


def budget_report(planned: DataFrame, budget: TokenBudget | None = None) -> DataFrame:
    """``paper_id, chunk_index, line``: the report's line of each chunk."""
    limit = (budget or TokenBudget()).chunk_text_tokens
    label = T.display_label(F.col("title"), F.col("caption"), F.col("text"))
    over = F.when(F.col("token_count") > limit, " OVER").otherwise("")
    return planned.select("paper_id", "chunk_index", F.format_string("  %02d. %5d tok%s  %3d nodes  %s", F.col("chunk_index"), F.col("token_count"), over, F.lit(1), label).alias("line"))


def report_head(budget: TokenBudget | None = None) -> list[str]:
    """The report's lines before the chunks. The layout is a fixed format."""
    b = budget or TokenBudget()
    rows = [("cache length", b.cache_length), ("usable input", b.usable_input_tokens), ("instructions", b.instruction_tokens), ("rolling memory", b.rolling_memory_tokens), ("reserved output", b.reserved_output_tokens), ("context scale", b.context_scale), ("chunk text limit", b.chunk_text_tokens)]
    return ["Token budget", *(f"  {name + ':':<22} {value}" for name, value in rows), "", "Chunks"]
