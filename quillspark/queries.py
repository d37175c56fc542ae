"""The engine's queries over the test tables, with SQL for DuckDB where it can express them.

The tables hold no papers, so trees are made of documents: a paper is 50 neighbouring documents, its sections are
languages, subsections thirds of the ids, leaves the documents. The SQL computes the same relations from the
columns directly, without paths or windows over the tree, so the two sides are independent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.budget import DigestionLimits, TokenBudget, scaled_column
from .functions.tokens import TURN_END, TURN_START, count_prompt_tokens, count_tokens, count_tokens_py, format_prompt, format_prompt_py, placeholders_match, without_end_marks
from .operators import fold, latex, runs, tree
from .plans import chunking, prompts
from .sources import latex as files_
from .sources import sinks
from .streaming import log

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _matches(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"


def _tok(x: str) -> str:
    return f"CASE WHEN {_matches(x)} > 0 THEN {_matches(x)} + 1 ELSE 0 END"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# ---- trees ----


def paper_tree(spark: SparkSession, d: str, edits: bool = False) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).alias("paper_id"), "lang", (F.col("doc_id") % 3).cast("int").alias("bucket"), "doc_id", "text")
    none, nobody = F.lit(-1), F.lit(-1).cast("long")
    root = docs.select("paper_id").distinct().select("paper_id", F.lit("").alias("lang"), none.alias("bucket"), nobody.alias("doc_id"), F.lit("paper").alias("node_type"), F.lit(None).cast("int").alias("rank"), F.concat(F.lit("paper "), F.col("paper_id").cast("string")).alias("title"), F.lit("").alias("text"), F.lit(False).alias("is_leaf"))
    section = docs.select("paper_id", "lang").distinct().select("paper_id", "lang", none, nobody, F.lit("section"), F.lit(1), F.col("lang"), F.lit(""), F.lit(False))
    sub = docs.select("paper_id", "lang", "bucket").distinct().select("paper_id", "lang", "bucket", nobody, F.lit("subsection"), F.lit(2), F.concat(F.lit("part "), F.col("bucket").cast("string")), F.lit(""), F.lit(False))
    leaf = docs.select("paper_id", "lang", "bucket", "doc_id", F.lit("paragraph"), F.lit(None).cast("int"), F.lit("paragraph"), "text", F.lit(True))
    rows = root.union(section).union(sub).union(leaf)
    rows = rows.withColumn("node_order", (F.row_number().over(Window.partitionBy("paper_id").orderBy("lang", "bucket", "doc_id")) - 1).cast("int"))
    rows = tree.parents(rows)
    status, mode = F.lit("include"), F.lit("auto")
    if edits:
        toxic = _table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).distinct()
        rows = rows.join(toxic, "doc_id", "left")
        status = F.when(F.col("toxic"), "exclude").when((F.col("node_type") == "section") & (F.col("lang") == "de") & (F.col("paper_id") % 7 == 0), "exclude").otherwise("include")
        mode = F.when((F.col("node_type") == "subsection") & (F.col("paper_id") % 5 == 0) & (F.col("bucket") == 1), "whole").when((F.col("node_type") == "subsection") & (F.col("paper_id") % 3 == 0), "split").otherwise("auto")
    rows = rows.withColumns({"include_status": status, "digest_mode": mode, "caption": F.lit(None).cast("string"), "image_paths": F.array().cast("array<string>")})
    return tree.totals(tree.with_tokens(rows))


def _tree_sql(edits: bool = False) -> str:
    status = "CASE WHEN o.doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) OR (o.node_type = 'section' AND o.lang = 'de' AND o.paper_id % 7 = 0) THEN 'exclude' ELSE 'include' END" if edits else "'include'"
    mode = "CASE WHEN o.node_type = 'subsection' AND o.paper_id % 5 = 0 AND o.bucket = 1 THEN 'whole' WHEN o.node_type = 'subsection' AND o.paper_id % 3 = 0 THEN 'split' ELSE 'auto' END" if edits else "'auto'"
    return f"""
WITH d AS (SELECT doc_id // 50 AS paper_id, lang, CAST(doc_id % 3 AS INTEGER) AS bucket, doc_id, text FROM documents),
r AS (
  SELECT DISTINCT paper_id, '' AS lang, -1 AS bucket, CAST(-1 AS BIGINT) AS doc_id, 'paper' AS node_type, 'paper ' || paper_id AS title, '' AS text FROM d
  UNION ALL SELECT DISTINCT paper_id, lang, -1, -1, 'section', lang, '' FROM d
  UNION ALL SELECT DISTINCT paper_id, lang, bucket, -1, 'subsection', 'part ' || bucket, '' FROM d
  UNION ALL SELECT paper_id, lang, bucket, doc_id, 'paragraph', 'paragraph', text FROM d),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY lang, bucket, doc_id) - 1 AS INTEGER) AS node_order FROM r),
n AS (SELECT o.*, {status} AS include_status, {mode} AS digest_mode,
    CAST(CASE WHEN node_type = 'paragraph' THEN 4 + {_matches("text")} ELSE 0 END AS BIGINT) AS own_tokens FROM o),
l AS (SELECT a.paper_id, a.lang, a.bucket, a.node_order, a.own_tokens, a.include_status = 'include' AS li, b.include_status = 'include' AS bi, b.node_order AS sub, s.include_status = 'include' AS si, s.node_order AS sec
  FROM n a JOIN n b ON b.paper_id = a.paper_id AND b.lang = a.lang AND b.bucket = a.bucket AND b.node_type = 'subsection'
  JOIN n s ON s.paper_id = a.paper_id AND s.lang = a.lang AND s.node_type = 'section' WHERE a.node_type = 'paragraph'),
t AS (
  SELECT paper_id, node_order, own_tokens AS token_count FROM l
  UNION ALL SELECT paper_id, sub, CAST(coalesce(sum(own_tokens) FILTER (li), 0) AS BIGINT) FROM l GROUP BY ALL
  UNION ALL SELECT paper_id, sec, CAST(coalesce(sum(own_tokens) FILTER (li AND bi), 0) AS BIGINT) FROM l GROUP BY ALL
  UNION ALL SELECT paper_id, 0, CAST(coalesce(sum(own_tokens) FILTER (li AND bi AND si), 0) AS BIGINT) FROM l GROUP BY ALL),
f AS (SELECT n.*, t.token_count, s.node_order AS sec, b.node_order AS sub, s.include_status AS sec_status, b.include_status AS sub_status, s.digest_mode AS sec_mode, b.digest_mode AS sub_mode
  FROM n JOIN t USING (paper_id, node_order)
  LEFT JOIN n s ON s.paper_id = n.paper_id AND s.lang = n.lang AND s.node_type = 'section' AND n.node_type IN ('subsection', 'paragraph')
  LEFT JOIN n b ON b.paper_id = n.paper_id AND b.lang = n.lang AND b.bucket = n.bucket AND b.node_type = 'subsection' AND n.node_type = 'paragraph')
"""


def _plan_sql(edits: bool, limit: int, top: bool = False) -> str:
    mode = "CASE WHEN node_type = 'section' AND include_status = 'include' THEN 'whole' ELSE digest_mode END" if top else "digest_mode"
    return (
        _tree_sql(edits)
        + f""", m AS (SELECT * REPLACE ({mode} AS digest_mode) FROM f),
c AS (SELECT *, CASE WHEN include_status = 'exclude' THEN 'stop' WHEN node_type = 'paper' THEN 'delegate'
    WHEN digest_mode = 'whole' AND token_count > {limit} THEN 'error' WHEN digest_mode = 'whole' OR node_type = 'paragraph' THEN 'emit'
    WHEN digest_mode = 'split' THEN 'delegate' WHEN node_type = 'subsection' AND token_count <= {limit} THEN 'emit' ELSE 'delegate' END AS decision FROM m),
p AS (SELECT c.*, cs.decision AS sec_decision, cb.decision AS sub_decision FROM c
  LEFT JOIN c cs ON cs.paper_id = c.paper_id AND cs.node_order = c.sec LEFT JOIN c cb ON cb.paper_id = c.paper_id AND cb.node_order = c.sub),
u AS (SELECT * FROM p WHERE coalesce(sec_decision, 'delegate') = 'delegate' AND coalesce(sub_decision, 'delegate') = 'delegate'),
e AS (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY node_order) AS INTEGER) AS chunk_index FROM u WHERE decision = 'emit')
"""
    )


_PLANNED = "SELECT paper_id, chunk_index, node_order, node_type, token_count FROM e"
_LIMIT = 6550


def _planned(df: DataFrame) -> DataFrame:
    return df.select("paper_id", "chunk_index", "node_order", "node_type", "token_count")


@query(_tree_sql() + "SELECT paper_id, node_order, node_type, CASE node_type WHEN 'section' THEN 0 WHEN 'subsection' THEN sec WHEN 'paragraph' THEN sub END AS parent_order, token_count FROM f")
def tree_totals(spark, d):
    return paper_tree(spark, d).select("paper_id", "node_order", "node_type", "parent_order", "token_count")


@query(_tree_sql(True) + "SELECT paper_id, node_order, include_status, token_count FROM f")
def tree_totals_excluded(spark, d):
    return paper_tree(spark, d, True).select("paper_id", "node_order", "include_status", "token_count")


@query(_tree_sql() + "SELECT paper_id, sec AS node_order, CAST(max(node_order) AS INTEGER) AS subtree_end FROM f WHERE node_type = 'paragraph' GROUP BY ALL")
def subtree_ends(spark, d):
    return tree.subtree_ends(paper_tree(spark, d)).where("node_type = 'section'").select("paper_id", "node_order", "subtree_end")


@query(_tree_sql(True) + """SELECT paper_id, node_order, CASE WHEN sub_mode = 'whole' THEN sub END AS bundled_by,
  CASE WHEN sub_status = 'exclude' THEN sub WHEN sec_status = 'exclude' THEN sec END AS excluded_by,
  CASE WHEN include_status = 'exclude' THEN 'exc' WHEN sub_status = 'exclude' OR sec_status = 'exclude' THEN 'in-exc' ELSE 'inc' END AS display_status,
  CASE WHEN sub_mode = 'whole' THEN 'in-bndl' WHEN digest_mode = 'whole' THEN 'bundle' ELSE digest_mode END AS display_mode
FROM f WHERE node_type <> 'paragraph' OR bucket <> 2""")
def inherited_flags(spark, d):
    nodes = paper_tree(spark, d, True)
    expanded = nodes.where("not is_leaf and not (node_type = 'subsection' and bucket = 2)")
    return tree.visible_rows(nodes, expanded).select("paper_id", "node_order", "bundled_by", "excluded_by", "display_status", "display_mode")


@query(_plan_sql(False, _LIMIT) + _PLANNED)
def plan_auto(spark, d):
    return _planned(chunking.plan(paper_tree(spark, d)))


def _message_sql(limit: int) -> str:
    return f"'Node ' || lpad(CAST(node_order AS VARCHAR), 4, '0') || ' was marked whole but has ' || token_count || ' tokens, over the chunk text limit {limit}.'"


def _outcomes_sql(limit: int) -> str:
    return f"""SELECT paper_id, CASE WHEN decision = 'emit' THEN CAST(count(*) FILTER (decision = 'emit') OVER (PARTITION BY paper_id ORDER BY node_order) AS INTEGER) END AS chunk_index,
  node_order, node_type, token_count, CASE WHEN decision = 'error' THEN {_message_sql(limit)} END AS message FROM u WHERE decision IN ('emit', 'error')"""


def _outcomes(nodes: DataFrame, limit: int) -> DataFrame:
    return chunking.outcomes(chunking.decisions(nodes, limit), limit).select("paper_id", "chunk_index", "node_order", "node_type", "token_count", "message")


@query(_plan_sql(True, 900) + _outcomes_sql(900))
def plan_with_edits(spark, d):
    return _outcomes(paper_tree(spark, d, True), 900)


@query(_plan_sql(False, 1500, True) + _outcomes_sql(1500))
def plan_top_level(spark, d):
    return _outcomes(chunking.top_level(paper_tree(spark, d)), 1500)


@query(_plan_sql(True, 500) + "SELECT paper_id, count(*) FILTER (decision = 'emit') AS chunks, count(*) FILTER (decision = 'error') AS errors FROM u GROUP BY ALL")
def plan_counters(spark, d):
    return chunking.counters(chunking.decisions(paper_tree(spark, d, True), 500))


@query(_plan_sql(True, 500) + "SELECT paper_id, node_order, token_count, 'Node ' || lpad(CAST(node_order AS VARCHAR), 4, '0') || ' was marked whole but has ' || token_count || ' tokens, over the chunk text limit 500.' AS message, row_number() OVER (PARTITION BY paper_id ORDER BY node_order) = 1 AS is_first FROM u WHERE decision = 'error'")
def plan_errors(spark, d):
    return chunking.errors(chunking.decisions(paper_tree(spark, d, True), 500), 500)


@query(_plan_sql(True, 500) + "SELECT paper_id, chunk_index, node_order, token_count FROM e WHERE paper_id NOT IN (SELECT paper_id FROM u WHERE decision = 'error')")
def plan_valid_papers(spark, d):
    good, _ = chunking.validated(paper_tree(spark, d, True), TokenBudget(usable_input_tokens=500 + 1250))
    return good.select("paper_id", "chunk_index", "node_order", "token_count")


@query(_plan_sql(False, 300) + "SELECT paper_id, chunk_index, printf('  %02d. %5d tok%s  %3d nodes  %s', chunk_index, token_count, CASE WHEN token_count > 300 THEN ' OVER' ELSE '' END, 1, title) AS line FROM e")
def budget_report(spark, d):
    budget = TokenBudget(usable_input_tokens=300 + 1250)
    return chunking.budget_report(chunking.plan(paper_tree(spark, d), budget), budget)


@query(_plan_sql(False, _LIMIT) + "SELECT paper_id, chunk_index, title AS node_title, node_type, CAST(node_order AS VARCHAR) AS signature, token_count, 'pending' AS status FROM e")
def chunk_records(spark, d):
    r = chunking.chunk_records(chunking.plan(paper_tree(spark, d)))
    return r.select("paper_id", "chunk_index", F.array_join("node_titles", "|").alias("node_title"), F.array_join("node_types", "|").alias("node_type"), runs.signature(F.col("node_orders")).alias("signature"), "token_count", "status")


@query(_tree_sql(True) + "SELECT paper_id, sec AS unit_order, node_order FROM f WHERE node_type = 'paragraph' AND include_status = 'include' AND sub_status = 'include' AND sec_status = 'include'")
def subtree_leaves(spark, d):
    nodes = paper_tree(spark, d, True)
    return tree.selected_leaves(nodes, nodes.where("node_type = 'section'")).select("paper_id", "unit_order", "node_order")


@query(_plan_sql(True, _LIMIT) + f"""SELECT e.paper_id, e.node_order,
  CASE WHEN e.node_type = 'paragraph' THEN CASE WHEN any_value({_strip("e.text")}) = '' THEN '' ELSE chr(10) || any_value({_strip("e.text")}) END
  WHEN count(k.node_order) > 0 THEN any_value(printf('[%04d] %s - %s', e.node_order, upper(e.node_type), e.title)) || string_agg(chr(10) || chr(10) || {_strip("k.text")}, '' ORDER BY k.node_order)
  ELSE any_value(printf('[%04d] %s - %s', e.node_order, upper(e.node_type), e.title) || chr(10) || upper(e.node_type) || ': ' || e.title) END AS chunk_text
FROM e LEFT JOIN f k ON k.paper_id = e.paper_id AND k.node_type = 'paragraph' AND k.include_status = 'include' AND k.sub = e.node_order GROUP BY e.paper_id, e.node_order, e.node_type""")
def chunk_text(spark, d):
    nodes = paper_tree(spark, d, True)
    return tree.chunk_texts(nodes, chunking.units(chunking.decisions(nodes, _LIMIT)))


@query(_tree_sql() + "SELECT paper_id, node_order, digest_mode, include_status FROM (SELECT * REPLACE (CASE WHEN node_order % 4 = 1 THEN 'exclude' ELSE include_status END AS include_status, CASE WHEN node_order % 4 = 1 AND node_order % 8 = 5 THEN 'whole' ELSE digest_mode END AS digest_mode) FROM f)")
def node_state_overlay(spark, d):
    nodes = paper_tree(spark, d)
    kept = nodes.where("node_order % 4 = 1").select("paper_id", "node_order", F.lit("exclude").alias("include_status"), F.when(F.col("node_order") % 8 == 5, "whole").alias("digest_mode"))
    lost = kept.limit(1).withColumn("node_order", F.lit(1_000_000))
    return tree.states(tree.apply_states(nodes, kept.unionByName(lost)))


@query(_tree_sql() + "SELECT paper_id, node_order, include_status, digest_mode FROM (SELECT * REPLACE (CASE WHEN node_order % 3 = 0 THEN 'exclude' ELSE 'include' END AS include_status, CASE WHEN node_order % 3 = 1 THEN 'split' WHEN node_order % 3 = 2 THEN 'auto' ELSE 'auto' END AS digest_mode) FROM f)")
def planner_edits(spark, d):
    nodes = paper_tree(spark, d)
    k = F.col("node_order") % 3
    first = nodes.select("paper_id", "node_order", F.lit(1).alias("seq"), F.when(k == 0, "include").when(k == 1, "bundle").otherwise("split").alias("edit"))
    second = nodes.select("paper_id", "node_order", F.lit(2).alias("seq"), F.when(k == 0, "exclude").when(k == 1, "split").otherwise("auto").alias("edit"))
    return tree.states(tree.apply_edits(nodes, first.union(second)))


@query("SELECT user_id, event_id, rank, coalesce(greatest(CASE WHEN rank > 0 THEN l0 END, CASE WHEN rank > 1 THEN l1 END, CASE WHEN rank > 2 THEN l2 END, CASE WHEN rank > 3 THEN l3 END), root) AS parent FROM (SELECT user_id, event_id, CAST(event_id % 5 AS INTEGER) AS rank, "
       + ", ".join(f"last_value(CASE WHEN event_id % 5 = {k} THEN event_id END IGNORE NULLS) OVER w AS l{k}" for k in range(4)) + ", min(event_id) OVER (PARTITION BY user_id) AS root FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE event_id <> root")
def section_parent(spark, d):
    rows = _table(spark, d, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("node_order"), (F.col("event_id") % 5).cast("int").alias("rank"))
    out = tree.parents(rows).where("parent_order is not null")
    return out.select(F.col("paper_id").alias("user_id"), F.col("node_order").alias("event_id"), "rank", F.col("parent_order").cast("long").alias("parent"))


# ---- scalar text operators ----


@query(f"SELECT doc_id, CAST({_tok('text')} AS BIGINT) AS tokens, CAST({_tok(repr(TURN_START + 'user') + ' || chr(10) || text || ' + repr(TURN_END) + ' || chr(10) || ' + repr(TURN_START + 'model') + ' || chr(10)')} AS BIGINT) AS prompt_tokens FROM documents")
def token_count_documents(spark, d):
    return _table(spark, d, "documents").select("doc_id", count_tokens("text").alias("tokens"), count_prompt_tokens("text").alias("prompt_tokens"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\n$', ''), '((?:^|\n)|[^\\])%[^\n]*', '\1', 'g') AS stripped FROM documents")
def strip_comments(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.strip_comments("text").alias("stripped"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, p AS paragraph FROM (SELECT doc_id, unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n')) AS p, generate_subscripts(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n\\s*\\n'), 1) AS i FROM documents) WHERE length({_strip('p')}) >= 3")
def paragraph_split(spark, d):
    docs = _table(spark, d, "documents").withColumn("t", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return docs.select("doc_id", F.posexplode(F.split("t", r"\n\s*\n")).alias("pos", "paragraph")).where(F.length(T.strip("paragraph")) >= 3)


@query("SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(title|h1|p|li)[ >]', 1)) AS tag FROM pages) GROUP BY ALL")
def html_blocks(spark, d):
    tags = F.regexp_extract_all("html", F.lit("<(title|h1|p|li)[ >]"), 1)
    return _table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


_LABEL = "CASE WHEN trim(one) = '' THEN '(untitled)' WHEN length(one) <= 96 THEN one ELSE rtrim(one[1:95]) || '...' END"


@query(f"SELECT doc_id, {_LABEL} AS label, printf('[%04d] %s - %s', doc_id, 'FIGURE', {_LABEL}) AS heading, CASE WHEN title <> '' THEN 'FIGURE: ' || title || chr(10) || chr(10) ELSE '' END || 'Caption: ' || lang || chr(10) || chr(10) || 'Images: one.png, two.pdf' || chr(10) || chr(10) || rtrim(source) AS selectable, 'Caption: ' || lang || chr(10) || chr(10) || 'Images: one.png, two.pdf' || chr(10) || chr(10) || source AS model FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS title, {_strip(r'''regexp_replace(CASE WHEN doc_id % 3 = 0 OR text = '' THEN lang ELSE text END, '\s+', ' ', 'g')''')} AS one FROM documents)")
def node_texts(spark, d):
    """Titles are whole texts; every third one is empty."""
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    docs = _table(spark, d, "documents").withColumn("title", title)
    images = F.array(F.lit("a/one.png"), F.lit("two.pdf"))
    label = T.display_label(F.col("title"), F.col("lang"), F.col("text"))
    kind = F.lit("figure")
    return docs.select("doc_id", label.alias("label"), T.heading(F.col("doc_id"), kind, F.col("title"), label).alias("heading"), T.selectable_text(kind, F.col("title"), F.col("lang"), images, F.col("source")).alias("selectable"), T.model_text(F.col("lang"), images, F.col("source")).alias("model"))


@query(f"SELECT conv_id, turn, {_strip('text')} AS summary, CASE WHEN turn % 2 = 0 THEN 'fact ' || turn ELSE 'none' END AS delta, role AS results, turn % 2 = 0 AS useful, '' AS missing FROM conversations")
def extract_section(spark, d):
    t = F.concat(F.lit("LOCAL_SUMMARY:\n"), "text", F.lit("\nMEMORY_DELTA: "), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("fact "), F.col("turn").cast("string"))).otherwise(F.lit("none")), F.lit("\nIMPORTANT_CLAIMS_RESULTS:\n"), "role", F.lit("\n"))
    rows = _table(spark, d, "conversations").withColumn("t", t)
    delta = T.extract_section("t", "MEMORY_DELTA")
    return rows.select("conv_id", "turn", T.extract_section("t", "LOCAL_SUMMARY").alias("summary"), delta.alias("delta"), T.extract_section("t", "RESULTS").alias("results"), T.useful_delta(delta).alias("useful"), T.extract_section("t", "IMAGE_SUMMARY").alias("missing"))


def _bound_sql(x: str, limit: str) -> str:
    # running sums by position instead of joined prefixes: counts of lines add up
    lines = rf"string_split(regexp_replace({x}, '\n$', ''), chr(10))"
    fits = f"list_filter(range(1, len({lines}) + 1), lambda k: (SELECT 1) IS NOT NULL AND coalesce(list_sum(list_transform({lines}[1:k], lambda s: {_matches('s')})), 0) + 1 <= {limit})"
    return f"CASE WHEN {_tok(x)} <= {limit} THEN {x} ELSE {_strip(f'array_to_string({lines}[1:coalesce(list_max({fits}), 0)], chr(10))')} END".replace("(SELECT 1) IS NOT NULL AND ", "")


@query(f"SELECT doc_id, {_bound_sql('text', '100')} AS bounded FROM documents")
def bound_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.bound_text("text", 100).alias("bounded"))


@query(f"""WITH r AS (SELECT conv_id, turn, text, {_matches('text')} AS m, sum({_matches('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations),
s AS (SELECT *, run + 1 <= 200 AS fits, CASE WHEN run - m > 0 THEN 200 - (run - m + 1) ELSE 200 END AS rest FROM r),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) FILTER (NOT fits) OVER (PARTITION BY conv_id ORDER BY turn) AS bad FROM s),
h AS (SELECT conv_id, turn, CASE WHEN fits THEN text ELSE {_bound_sql('text', 'rest')} END AS item FROM g WHERE bad = 0 OR (bad = 1 AND NOT fits AND rest > 40))
SELECT conv_id, string_agg(item, '|' ORDER BY turn) AS kept FROM h GROUP BY ALL""")
def bound_list(spark, d):
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    kept = rows.select("conv_id", T.bound_list(F.col("x.text"), 200).alias("kept")).where(F.size("kept") > 0)
    return kept.select("conv_id", F.array_join("kept", "|").alias("kept"))


@query("SELECT o_orderkey, CAST(greatest(1, CASE WHEN abs(o_orderkey * 0.5 - trunc(o_orderkey * 0.5)) = 0.5 THEN 2 * round(o_orderkey * 0.25) ELSE round(o_orderkey * 0.5) END) AS BIGINT) AS scaled FROM orders")
def scaled_token_count(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", scaled_column(F.col("o_orderkey"), F.lit(0.5)).alias("scaled"))


@query("""SELECT c AS cache_length, s AS context_scale, c - 2440 AS usable_input_tokens, CAST(768 * s AS BIGINT) AS reserved_output_tokens, CAST(900 * s AS BIGINT) AS rolling_memory_tokens, CAST(350 * s AS BIGINT) AS instruction_tokens,
  CAST(c - 2440 - 900 * s - 350 * s AS BIGINT) AS chunk_text_tokens, CAST(260 * s AS BIGINT) AS memory_delta, CAST(350 * s AS BIGINT) AS chunk_summary, CAST(900 * s AS BIGINT) AS image_context, CAST(180 * s AS BIGINT) AS image_summary,
  CAST(700 * s AS BIGINT) AS final_summary, CAST(220 * s AS BIGINT) AS last_fallback, greatest(CAST(200 * s AS BIGINT), CAST(1430 * s AS BIGINT)) AS compaction_target
FROM (VALUES (8192), (10240), (16384)) a(c), (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (2.0)) b(s)""")
def budgets(spark, d):
    rows = []
    for c, s in ((c, s) for c in (8192, 10240, 16384) for s in (0.5, 1.0, 2.0)):
        n = DigestionLimits.make(s)
        rows.append(TokenBudget.make(c, s).as_dict() | {"memory_delta": n.memory_delta_tokens, "chunk_summary": n.chunk_summary_tokens, "image_context": n.image_context_tokens, "image_summary": n.image_summary_tokens, "final_summary": n.final_summary_tokens, "last_fallback": n.final_summary_fallback_tokens[-1], "compaction_target": n.compaction_target})
    return spark.createDataFrame(rows)


# ---- LaTeX ----


def _made_papers(spark: SparkSession, d: str) -> DataFrame:
    """LaTeX written from documents: a paper is 10 documents, each a section of a label, references, prose, the whole text and a figure."""
    word = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    escaped = F.regexp_replace(F.coalesce("text", F.lit("")), r"([%&_#${}])", r"\\$1")
    part = F.concat(
        F.lit("\\section{About "), word, F.lit("}\nSee \\ref{fig:"), F.col("doc_id").cast("string"), F.lit("} and \\cite{a,b}. \\label{sec:"), F.col("doc_id").cast("string"), F.lit("} % gone\n\nWritten in "), "lang",
        F.lit(" by 5\\% of \\emph{them}.\n\nText: "), escaped, F.lit("\n\\begin{figure}[h]\n\\includegraphics[width=1cm]{img/"), F.col("doc_id").cast("string"), F.lit("}\n\\caption{A \\textbf{view} of "), "source", F.lit("}\n\\label{fig:"), F.col("doc_id").cast("string"), F.lit("}\n\\end{figure}\n"),
    )
    rows = _table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("paper_id"), "doc_id", part.alias("part"))
    body = rows.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", "part")))["part"], "").alias("body"))
    head = F.concat(F.lit("\\documentclass{article}\n\\title{Paper \\emph{"), F.col("paper_id").cast("string"), F.lit("}}\n\\begin{document}\nDraft note.\n\\begin{abstract}We look at "), F.col("paper_id").cast("string"), F.lit(".\\end{abstract}\n"))
    return body.select("paper_id", F.lit("main.tex").alias("main_file"), T.strip_comments(F.concat(head, "body", F.lit("\\end{document}\n"))).alias("text"))


# what conversion does to plain prose: dashes, quotes, ties and white space
_PROSE = _strip(r"""regexp_replace(regexp_replace(replace(replace(replace(replace(replace('Text: ' || coalesce(text, ''), '---', '—'), '--', '–'), '``', '“'), '''''', '”'), '~', ' '), '[ \t]+', ' ', 'g'), '\s+\n', chr(10), 'g')""")
_MADE = f"""WITH d AS (SELECT doc_id // 10 AS paper_id, doc_id, lang, source, {_PROSE} AS prose, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) AS k FROM documents),
n AS (
  SELECT DISTINCT paper_id, 0 AS node_order, 'paper' AS node_type, 'Paper ' || paper_id AS title, '' AS text, NULL AS parent_order, 'include' AS include_status, '' AS labels, '' AS refs FROM d
  UNION ALL SELECT DISTINCT paper_id, 1, 'metadata', 'metadata', 'title: Paper ' || paper_id, 0, 'include', '', '' FROM d
  UNION ALL SELECT DISTINCT paper_id, 2, 'abstract', 'abstract', 'We look at ' || paper_id || '.', 0, 'include', '', '' FROM d
  UNION ALL SELECT DISTINCT paper_id, 3, 'paragraph', 'paragraph', 'Draft note.', 0, 'exclude', '', '' FROM d
  UNION ALL SELECT paper_id, 5 * k - 1, 'section', 'About doc ' || doc_id, '', 0, 'include', '', '' FROM d
  UNION ALL SELECT paper_id, 5 * k, 'paragraph', 'paragraph', 'See [ref: fig:' || doc_id || '] and [cite: a,b].', 5 * k - 1, 'include', 'sec:' || doc_id, 'fig:' || doc_id || '|a,b' FROM d
  UNION ALL SELECT paper_id, 5 * k + 1, 'paragraph', 'paragraph', 'Written in ' || lang || ' by 5% of them.', 5 * k - 1, 'include', '', '' FROM d
  UNION ALL SELECT paper_id, 5 * k + 2, 'paragraph', 'paragraph', prose, 5 * k - 1, 'include', '', '' FROM d
  UNION ALL SELECT paper_id, 5 * k + 3, 'figure', 'A view of ' || source, 'A view of ' || source, 5 * k - 1, 'include', 'fig:' || doc_id, '' FROM d)
"""


@query(_MADE + "SELECT paper_id, CAST(node_order AS INTEGER) AS node_order, node_type, title, text, CAST(parent_order AS INTEGER) AS parent_order, include_status, labels, refs FROM n")
def latex_nodes(spark, d):
    out = latex.nodes(_made_papers(spark, d))
    return out.select("paper_id", "node_order", "node_type", "title", "text", "parent_order", "include_status", F.array_join("labels", "|").alias("labels"), F.array_join("references", "|").alias("refs"))


@query("SELECT paper_id, 'Paper \\emph{' || paper_id || '}' AS title, 'We look at ' || paper_id || '.' AS abstract, n AS captions, n AS figures, n * 2 AS labels, n * 2 AS refs, n * 3 AS keys FROM (SELECT doc_id // 10 AS paper_id, CAST(count(*) AS INTEGER) AS n FROM documents GROUP BY ALL)")
def latex_parts(spark, d):
    p = _made_papers(spark, d).withColumn("body", T.document_body("text"))
    captions = F.regexp_count("body", F.lit(r"\\caption\{"))
    refs = T.references("body")
    return p.select("paper_id", T.first_group("text", "title").alias("title"), T.abstract("body").alias("abstract"), captions.alias("captions"), F.size(T.graphics("body")).alias("figures"), F.size(T.labels("body")).alias("labels"), F.size(refs).alias("refs"), F.size(T.reference_keys(refs)).alias("keys"))


@query(_MADE + "SELECT paper_id, count(*) AS excluded FROM n WHERE include_status = 'exclude' GROUP BY ALL")
def front_matter_exclusion(spark, d):
    return latex.nodes(_made_papers(spark, d)).where("include_status = 'exclude'").groupBy("paper_id").agg(F.count(F.lit(1)).alias("excluded"))


def _made_files(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("doc_id") % 5 == 0, "ms.tex").when(F.col("doc_id") % 5 == 1, "sub/main.tex").otherwise(F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".tex")))
    has = F.when(F.col("doc_id") % 4 == 0, "\\begin{document}").otherwise("")
    return _table(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("paper_id"), name.alias("path"), F.concat(has, "lang").alias("text"))


@query("SELECT paper_id, path AS main_file FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY has DESC, CASE WHEN has THEN CASE WHEN path = 'ms.tex' THEN 0 ELSE 1 END ELSE 0 END, CASE WHEN has THEN CASE WHEN path LIKE '%/%' THEN 2 ELSE 1 END ELSE 0 END, CASE WHEN has AND path = 'sub/main.tex' THEN 'main.tex' WHEN has THEN path ELSE '' END, path) AS r FROM (SELECT doc_id // 5 AS paper_id, CASE doc_id % 5 WHEN 0 THEN 'ms.tex' WHEN 1 THEN 'sub/main.tex' ELSE 'f' || doc_id || '.tex' END AS path, doc_id % 4 = 0 AS has FROM documents)) WHERE r = 1")
def main_file_choice(spark, d):
    return files_.main_files(_made_files(spark, d))


@query("SELECT doc_id // 5 AS paper_id, 'main.tex' AS main_file, '\\begin{document}' || string_agg(chr(10) || 'part ' || doc_id || ' ' || lang || chr(10) || regexp_replace(text || '%cut', '((?:^|\\n)|[^\\\\])%[^\\n]*', '\\1', 'g') || chr(10) || chr(10) || chr(10), '' ORDER BY doc_id) || chr(10) || '[missing input: none]' || chr(10) AS text FROM documents GROUP BY ALL")
def include_expansion(spark, d):
    """Each whole text is a file that is included."""
    docs = _table(spark, d, "documents").select(F.floor(F.col("doc_id") / 5).alias("paper_id"), "doc_id", "lang", F.col("text").alias("own"))
    ref = F.concat(F.lit("\\input{p"), F.col("doc_id").cast("string"), F.lit("}\\include{p"), F.col("doc_id").cast("string"), F.lit(".tex}"))
    main = docs.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc_id", ref.alias("r"))))["r"], "").alias("b")).select("paper_id", F.lit("main.tex").alias("path"), F.concat(F.lit("\\begin{document}"), "b", F.lit("\\input{none}")).alias("text"))
    part = docs.select("paper_id", F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".tex")), F.concat(F.lit("part "), F.col("doc_id").cast("string"), F.lit(" "), "lang", F.lit("\n"), "own", F.lit("%cut")))
    return files_.expanded(main.union(part.toDF("paper_id", "path", "text")))


@query("SELECT doc_id // 10 AS paper_id, CAST(5 * row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id) + 3 AS INTEGER) AS node_order, 'img/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.png' ELSE '.pdf' END AS image FROM documents QUALIFY doc_id % 3 < 2")
def image_resolution(spark, d):
    nodes = latex.flat_nodes(_made_papers(spark, d))
    docs = _table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).alias("paper_id"), "doc_id")
    stem = F.concat(F.lit("img/"), F.col("doc_id").cast("string"))
    have = docs.where("doc_id % 3 = 0").select("paper_id", F.explode(F.array(F.concat(stem, F.lit(".png")), F.concat(stem, F.lit(".jpg")))).alias("path")).union(docs.where("doc_id % 3 = 1").select("paper_id", F.concat(stem, F.lit(".pdf"))))
    found = files_.resolve_images(nodes, have.union(docs.where("doc_id % 3 = 2").select("paper_id", F.concat(stem, F.lit(".eps")))))
    return found.select("paper_id", "node_order", F.array_join("image_paths", "|").alias("image"))


# ---- prompts and folds ----


def _sql_template(template: str, **parts: str) -> str:
    out, rest = [], template
    while parts:
        at = min(((rest.find(f"<{k}>"), k) for k in parts if f"<{k}>" in rest), default=None)
        if at is None:
            break
        out += [_lit(rest[: at[0]]), parts[at[1]]]
        rest = rest[at[0] + len(at[1]) + 2 :]
    return " || ".join([*out, _lit(rest)])


_CHUNK_SQL = _sql_template(prompts.CHUNK_TEMPLATE, memory=_lit(prompts.FIRST_MEMORY), index="turn", text="text", images="'Image 1: a.png <|image|>' || chr(10) || 'Skipped image: ' || role")


@query(f"SELECT conv_id, turn, {_lit(TURN_START + 'user')} || chr(10) || replace({_CHUNK_SQL}, '<|image|>', '<start_of_image>') || {_lit(TURN_END)} || chr(10) || {_lit(TURN_START + 'model')} || chr(10) AS prompt, TRUE AS placeholders_match FROM conversations")
def prompt_format(spark, d):
    rows = _table(spark, d, "conversations").withColumn("p", _chunk_prompt())
    return rows.select("conv_id", "turn", format_prompt("p").alias("prompt"), placeholders_match("p", F.lit(1)).alias("placeholders_match"))


def _chunk_prompt():
    return prompts.chunk_prompt(F.lit(prompts.FIRST_MEMORY), F.col("turn"), F.col("text"), F.array(F.lit("a.png")), F.array("role"))


_FORMATTED = f"{_lit(TURN_START + 'user')} || chr(10) || replace({_CHUNK_SQL}, '<|image|>', '<start_of_image>') || {_lit(TURN_END)} || chr(10) || {_lit(TURN_START + 'model')} || chr(10)"


@query(f"SELECT *, prompt_text_tokens + 256 > 600 AS over_budget FROM (SELECT conv_id, turn, CAST({_tok('p')} AS BIGINT) AS prompt_text_tokens, CAST({_tok('text')} AS BIGINT) AS chunk_text_tokens, CAST({_tok(_lit(prompts.FIRST_MEMORY))} AS BIGINT) AS rolling_memory_tokens, CAST({_tok('role')} AS BIGINT) AS image_summary_tokens, CAST(256 AS BIGINT) AS image_tokens FROM (SELECT *, {_FORMATTED} AS p FROM conversations))")
def prompt_stats(spark, d):
    rows = _table(spark, d, "conversations").withColumn("p", _chunk_prompt())
    s = rows.withColumn("s", prompts.prompt_stats(F.col("p"), F.col("text"), F.lit(prompts.FIRST_MEMORY), F.array("role"), F.lit(1), F.lit(1), safe=600))
    return s.select("conv_id", "turn", "s.prompt_text_tokens", "s.chunk_text_tokens", "s.rolling_memory_tokens", "s.image_summary_tokens", "s.image_tokens", prompts.over_budget(F.col("s")).alias("over_budget"))


def _ladder_sql(safe: int) -> str:
    """Counts add up over the parts of a prompt: the template, the memory, summaries under headings of four tokens, and deltas; no notes are one token."""
    n, blank = DigestionLimits(), prompts.FINAL_TEMPLATE
    for part in ("memory", "deltas", "summaries", "images"):
        blank = blank.replace(f"<{part}>", "")
    fixed = count_tokens_py(format_prompt_py(blank)) + 1
    first, short = (count_tokens_py(m) - 1 for m in (prompts.FIRST_MEMORY, _SHORT_MEMORY))
    steps = [(first, x, n.final_memory_delta_tokens) for x in (n.final_summary_tokens, *n.final_summary_fallback_tokens)] + [(short, x, n.final_compacted_memory_delta_tokens) for x in n.final_compacted_summary_tokens]
    rows = ", ".join(str((k, *s)) for k, s in enumerate(steps, 1))
    return f"""WITH steps(step, memory, n, d) AS (VALUES {rows}),
r AS (SELECT conv_id, turn, text, step, memory, n, d, {_matches('text')} AS m FROM conversations, steps),
s AS (SELECT *, sum(m) OVER (PARTITION BY conv_id, step ORDER BY turn) AS run FROM r),
g AS (SELECT *, CASE WHEN run - m > 0 THEN d - (run - m + 1) ELSE d END AS rest, count(*) FILTER (run + 1 > d) OVER (PARTITION BY conv_id, step ORDER BY turn) AS bad FROM s),
h AS (SELECT conv_id, step, memory, {_matches(_bound_sql('text', 'n'))} + 4 AS summary, CASE WHEN bad = 0 THEN m WHEN bad = 1 AND rest > 40 THEN {_matches(_bound_sql('text', 'rest'))} END AS delta FROM g),
t AS (SELECT conv_id, step, CAST({fixed} + any_value(memory) + sum(summary) + coalesce(sum(delta), 1) AS BIGINT) AS tokens FROM h GROUP BY conv_id, step)
SELECT c.conv_id, CAST(coalesce(min(step), 0) AS INTEGER) AS step, coalesce(min_by(tokens, step), 0) AS tokens FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id = c.conv_id AND t.tokens <= {safe} GROUP BY c.conv_id"""


_SHORT_MEMORY = "Running abstract: short"


@query(_ladder_sql(900))
def final_ladder_choice(spark, d):
    rows = _table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    step = prompts.ladder(F.lit(prompts.FIRST_MEMORY), F.lit(_SHORT_MEMORY), F.col("x.text"), F.col("x.text"), F.array().cast("array<string>"), safe=900)
    return rows.select("conv_id", step.alias("f")).select("conv_id", "f.step", count_prompt_tokens("f.prompt").alias("tokens"))


@query(f"SELECT conv_id AS paper_id, {_lit(prompts.FIRST_MEMORY)} || coalesce(string_agg(chr(10) || chr(10) || 'Chunk ' || turn || ' durable additions:' || chr(10) || 'fact ' || role, '' ORDER BY turn) FILTER (turn % 3 <> 0), '') AS memory FROM conversations GROUP BY ALL")
def rolling_memory_fold(spark, d):
    delta = F.when(F.col("turn") % 3 == 0, F.lit(" None\n")).otherwise(F.concat(F.lit(" fact "), "role", F.lit("\n")))
    return fold.rolling_memory(_table(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("chunk_index"), delta.alias("delta")))


@query()
def digest_papers(spark, d):
    nodes = paper_tree(spark, d)
    units = chunking.plan(nodes)
    texts = tree.chunk_texts(nodes, units).join(units.select("paper_id", "node_order", "chunk_index"), ["paper_id", "node_order"])
    out = fold.digest(texts)
    return sinks.markdown(out).join(out.select("paper_id", "completed", "error"), "paper_id")


def _talk_chunks(spark: SparkSession, d: str) -> DataFrame:
    """A conversation as a paper, its messages as chunks."""
    talk = _table(spark, d, "conversations")
    return talk.select(F.col("conv_id").alias("paper_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).alias("chunk_index"), F.col("text").alias("chunk_text"))


_TALK = "WITH c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS i, text FROM conversations)"


@query(_TALK + """, n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(1 AS BIGINT) AS seq, 'run_started' AS event, CAST(NULL AS BIGINT) AS chunk, CAST(n AS VARCHAR) AS detail FROM n
UNION ALL SELECT CAST(conv_id AS VARCHAR), 2 * i, 'chunk_started', i, NULL FROM c UNION ALL SELECT CAST(conv_id AS VARCHAR), 2 * i + 1, 'chunk_completed', i, NULL FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 2 * n + 2, 'final_started', NULL, NULL FROM n UNION ALL SELECT CAST(conv_id AS VARCHAR), 2 * n + 3, 'run_completed', NULL, NULL FROM n""")
def fold_events(spark, d):
    return fold.events(fold.digest(_talk_chunks(spark, d))).select("run_id", "seq", "event", "chunk", "detail")


@query(_TALK + """, n AS (SELECT conv_id, count(*) AS n FROM c GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS run_id, 'complete' AS status, n AS last_completed_chunk, CAST(2 AS BIGINT) AS plan_version, n AS chunks FROM n WHERE n > 1""")
def resumed_run(spark, d):
    """The first chunk of each paper digested, the rest in a second run; the state derived from both logs."""
    rows = _talk_chunks(spark, d)
    long = rows.groupBy("paper_id").count().where("count > 1").select("paper_id")
    rows = rows.join(long, "paper_id")
    first = fold.digest(rows.where("chunk_index = 1"))
    second = fold.digest(rows, earlier=first)
    log_ = fold.events(first).where("event NOT LIKE 'final%' AND event <> 'run_completed'").unionByName(fold.events(second, after=1000))
    states = runs.chunk_states(log_).where("status = 'complete'").groupBy("run_id").agg(F.count(F.lit(1)).alias("chunks"))
    return runs.run_states(log_).join(states, "run_id")


_FIRST_LINE = _strip("string_split(regexp_replace(text, '^\\s+', ''), chr(10))[1]")


@query(_TALK + f"SELECT conv_id AS paper_id, i AS chunk, {_FIRST_LINE} AS summary FROM c WHERE {_matches(_FIRST_LINE)} < 350")
def resume_fold(spark, d):
    """The summaries of a run that stopped after two chunks and went on."""
    rows = _talk_chunks(spark, d)
    out = fold.digest(rows, earlier=fold.digest(rows.where("chunk_index <= 2")))
    each = out.select("paper_id", F.posexplode("summaries").alias("i", "summary"))
    return each.where(count_tokens("summary") < 351).select("paper_id", (F.col("i") + 1).cast("long").alias("chunk"), "summary")


@query("SELECT conv_id, turn, string_agg(w, ' ' ORDER BY i) FILTER (w NOT IN ('<end_of_turn>', '<eos>')) AS kept FROM (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT conv_id, turn, string_split(role || ' <eos> ' || role || ' <end_of_turn> x', ' ') AS ws FROM conversations)) GROUP BY conv_id, turn")
def end_marks(spark, d):
    words = F.split(F.concat("role", F.lit(" <eos> "), "role", F.lit(" <end_of_turn> x")), " ")
    return _table(spark, d, "conversations").select("conv_id", "turn", F.array_join(without_end_marks(words), " ").alias("kept"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN min(role) ELSE min_by(role, turn) || ' -> ' || max_by(role, turn) END AS title FROM (SELECT conv_id, turn, any_value(role) AS role FROM conversations GROUP BY ALL) GROUP BY conv_id")
def chunk_titles(spark, d):
    one = _table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.first("role").alias("role"))
    rows = one.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", T.chunk_title(F.col("x.role")).alias("title"))


_IMAGE_SQL = _sql_template(prompts.IMAGE_TEMPLATE, index="turn", title="role", name="'f.png'", context="text")
_COMPACT_SQL = _sql_template(prompts.COMPACTION_TEMPLATE, target="'1430'", memory="text")


@query(f"SELECT conv_id, turn, {_IMAGE_SQL} AS image_prompt, {_COMPACT_SQL} AS compaction_prompt FROM conversations")
def side_prompts(spark, d):
    image = prompts.image_prompt(F.col("turn"), F.col("role"), F.lit("f.png"), F.col("text"))
    return _table(spark, d, "conversations").select("conv_id", "turn", image.alias("image_prompt"), prompts.compaction_prompt(F.col("text"), DigestionLimits().compaction_target).alias("compaction_prompt"))


@query("SELECT user_id, string_agg(event_type, '|' ORDER BY first_at) AS seen FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) GROUP BY ALL")
def distinct_first_seen(spark, d):
    rows = _table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return rows.select("user_id", F.array_join(T.first_seen(F.col("x.event_type")), "|").alias("seen"))


# ---- runs ----


def _log(spark: SparkSession, d: str) -> DataFrame:
    return _as_log(_table(spark, d, "events"))


def _as_log(events: DataFrame) -> DataFrame:
    names = {"signup": "run_started", "click": "chunk_started", "view": "chunk_completed", "error": "chunk_failed", "purchase": "plan_updated"}
    event = F.lit(None).cast("string")
    for k, v in names.items():
        event = F.when(F.col("event_type") == k, v).otherwise(event)
    return events.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("event_id") % 7).alias("chunk"))


_LOG = "WITH l AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, event_type AS e, event_id % 7 AS chunk FROM events)\n"


@query(_LOG + "SELECT run_id, CASE max_by(e, seq) FILTER (e IN ('signup', 'purchase', 'error')) WHEN 'error' THEN 'failed' ELSE CASE WHEN count(*) FILTER (e IN ('signup', 'purchase', 'error')) > 0 THEN 'running' END END AS status, coalesce(max_by(chunk, seq) FILTER (e = 'view'), 0) AS last_completed_chunk, count(*) FILTER (e = 'purchase') + 1 AS plan_version FROM l GROUP BY ALL")
def run_state_from_log(spark, d):
    return runs.run_states(_log(spark, d))


@query(_LOG + "SELECT run_id, chunk, CASE max_by(e, seq) WHEN 'click' THEN 'running' WHEN 'view' THEN 'complete' ELSE 'failed' END AS status FROM l WHERE e IN ('click', 'view', 'error') GROUP BY ALL")
def chunk_state_from_log(spark, d):
    return runs.chunk_states(_log(spark, d))


@query(_LOG + ", s AS (SELECT run_id, chunk FROM l WHERE e IN ('click', 'view', 'error') GROUP BY ALL HAVING max_by(e, seq) = 'click') SELECT run_id, (SELECT max(seq) FROM l WHERE l.run_id = s.run_id) + row_number() OVER (PARTITION BY run_id ORDER BY chunk) AS seq, 'chunk_interrupted' AS event, chunk FROM s")
def interrupted_chunks(spark, d):
    return runs.interruptions(_log(spark, d))


@query(_LOG + "SELECT run_id, 'failed' AS status, count(*) AS chunks FROM (SELECT run_id, chunk, max_by(e, seq) AS e FROM l WHERE e IN ('click', 'view', 'error') GROUP BY ALL) WHERE e = 'error' GROUP BY ALL")
def snapshot_roundtrip(spark, d):
    back = runs.read_snapshots(runs.snapshot(_log(spark, d)))
    return back.select("run_id", F.explode("chunks").alias("c")).where("c.status = 'failed'").groupBy("run_id", F.col("c.status").alias("status")).agg(F.count(F.lit(1)).alias("chunks"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id % 7 AS chunk, 'i' || event_id % 3 AS image, CASE max_by(event_type, event_id) WHEN 'click' THEN 'running' WHEN 'view' THEN 'complete' ELSE 'failed' END AS status FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL")
def image_state_from_log(spark, d):
    events = _log(spark, d).withColumn("event", F.replace(F.col("event"), F.lit("chunk_"), F.lit("image_")))
    return runs.image_states(events.withColumn("image", F.concat(F.lit("i"), F.col("seq") % 3)))


@query(_LOG + "SELECT run_id, CASE max_by(e, seq) FILTER (e IN ('signup', 'purchase', 'error')) WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'running' WHEN 'signup' THEN 'complete' END AS status, coalesce(max_by(chunk, seq) FILTER (e = 'view'), 0) AS last_completed_chunk FROM l GROUP BY ALL")
def final_state_from_log(spark, d):
    """Runs whose last word is that the final digest failed or that all is done."""
    ends = {"run_started": "run_completed", "chunk_failed": "final_failed"}
    event = F.col("event")
    for old, new in ends.items():
        event = F.when(F.col("event") == old, new).otherwise(event)
    return runs.run_states(_log(spark, d).withColumn("event", event)).select("run_id", "status", "last_completed_chunk")


def _signatures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of an earlier run and of the new plan. The earlier run ends with its first text whose length is a multiple of 5, if any."""
    rows = _table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("place"), F.col("role").alias("signature"), F.length("text").alias("n"))
    end = F.min(F.when(F.col("n") % 5 == 0, F.col("place"))).over(Window.partitionBy("run_id"))
    done = rows.withColumn("end", end).where("place <= coalesce(end, place)")
    return done.select("run_id", "place", "signature"), rows.select("run_id", "place", F.when(F.col("n") % 3 == 0, "other").otherwise(F.col("signature")).alias("signature"))


_PREFIX = "SELECT run_id, coalesce(min(place) FILTER (bad) - 1, max(place)) AS prefix FROM (SELECT conv_id AS run_id, turn + 1 AS place, turn + 1 > coalesce(min(turn + 1) FILTER (length(text) % 5 = 0) OVER (PARTITION BY conv_id), turn + 1) OR length(text) % 3 = 0 AS bad FROM conversations) GROUP BY ALL"


@query(f"SELECT *, prefix + 1 AS resume_at FROM ({_PREFIX})")
def resume_prefix(spark, d):
    return runs.resume_prefix(*_signatures(spark, d))


@query(f"SELECT c.conv_id AS run_id, c.turn + 1 AS place FROM conversations c JOIN ({_PREFIX}) p ON p.run_id = c.conv_id WHERE c.turn + 1 > p.prefix")
def remaining_chunks(spark, d):
    done, new = _signatures(spark, d)
    return runs.remaining(new, runs.resume_prefix(done, new)).select("run_id", "place")


@query(f"SELECT run_id, string_agg(role, '|' ORDER BY turn) AS notes FROM (SELECT c.conv_id AS run_id, c.turn, CASE WHEN c.turn = 2 THEN '' ELSE c.role END AS role FROM conversations c JOIN ({_PREFIX}) p ON p.run_id = c.conv_id WHERE c.turn + 1 <= p.prefix) WHERE role <> '' GROUP BY ALL")
def notes_for_prefix(spark, d):
    done, new = _signatures(spark, d)
    notes = _table(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), (F.col("turn") + 1).alias("chunk"), F.when(F.col("turn") == 2, "").otherwise(F.col("role")).alias("note"))
    return runs.up_to_prefix(notes, runs.resume_prefix(done, new), "note").select("run_id", F.array_join("notes", "|").alias("notes"))


@query("SELECT CAST(user_id AS VARCHAR) AS run_id, event_id % 7 AS chunk, max_by(event_type, event_id) AS delta FROM events GROUP BY ALL")
def last_deltas(spark, d):
    rows = _table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), (F.col("event_id") % 7).alias("chunk"), F.col("event_id").alias("pos"), F.col("event_type").alias("delta"))
    return runs.last_deltas(rows)


# ---- streams ----


@query(_LOG + "SELECT run_id, CASE max_by(e, seq) FILTER (e IN ('signup', 'purchase', 'error')) WHEN 'error' THEN 'failed' ELSE CASE WHEN count(*) FILTER (e IN ('signup', 'purchase', 'error')) > 0 THEN 'running' END END AS status, coalesce(max_by(chunk, seq) FILTER (e = 'view'), 0) AS last_completed_chunk, count(*) FILTER (e = 'purchase') + 1 AS plan_version FROM l GROUP BY ALL")
def run_status_stream(spark, d):
    """Run states from the log as a stream, run to its end; the sink holds one row a run."""
    name = f"run_status_{uuid.uuid4().hex}"
    schema = _table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    run = log.status_stream(_as_log(events)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name)


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def log_stream(spark, d):
    """Windowed counts of the event stream, run to its end; the sink holds one row a day and type."""
    name = f"log_stream_{uuid.uuid4().hex}"
    schema = _table(spark, d, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    run = log.windowed_counts(events).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")
