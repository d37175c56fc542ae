"""Golden cases, derived by reading: budgets, trees, plans, comments, bounds, sections, sources and logs."""

import io
import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.budget import DigestionLimits, TokenBudget, default_level, safe_input_tokens, scaled
from quillspark.functions.tokens import count_tokens, count_tokens_py
from quillspark.operators import fold, latex, runs, tree
from quillspark.plans import chunking, prompts
from quillspark.sources import images, sinks
from quillspark.sources import latex as source

PAPER = r"""% preamble
\documentclass{article}
\title{A \emph{Tiny} Paper}
\author{A. Writer}
\begin{document}
Draft note here.
\begin{abstract}We test trees.\end{abstract}
\section{Intro}
First paragraph with 5\% noise. % gone

Second paragraph.
\subsection{Setup}
\begin{figure}
\includegraphics[width=1cm]{fig/one}
\caption{A \textbf{bold} caption}
\label{fig:one}
\end{figure}
Text after.
\subsubsection{Deep}
Deep text.
\section{End}
\begin{thebibliography}{9}\bibitem{a} X.\end{thebibliography}
\end{document}
"""
WEIGHTS = {1: 10, 2: 8, 3: 6, 5: 20, 6: 15, 8: 30, 9: 5, 11: 7, 13: 50}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).head().x if values else spark.range(1).select(column.alias("x")).head().x


@pytest.mark.parametrize(("cache", "scale", "expected"), [(10240, 1, (7800, 768, 900, 350, 6550)), (10240, 2, (7800, 1536, 1800, 700, 5300)), (10240, 0.5, (7800, 384, 450, 175, 7175)), (8192, 1, (5752, 768, 900, 350, 4502)), (2441, 1, (1, 768, 900, 350, -1249))])
def test_budgets(cache, scale, expected):
    b = TokenBudget.make(cache, scale)
    assert (b.usable_input_tokens, b.reserved_output_tokens, b.rolling_memory_tokens, b.instruction_tokens, b.chunk_text_tokens) == expected


def test_budget_errors():
    with pytest.raises(ValueError):
        safe_input_tokens(2440)
    with pytest.raises(ValueError):
        scaled(5, 0)
    with pytest.raises(ValueError):
        default_level("chapterette")
    with pytest.raises(ValueError):
        chunking.checked_limit(TokenBudget.make(2441))
    assert [scaled(v, 0.5) for v in (1, 3, 5)] == [1, 2, 2]
    assert DigestionLimits().compaction_target == 1430
    assert chunking.report_head()[1] == "  cache length:          10240"


@pytest.mark.parametrize(("raw", "expected"), [("a % b", "a "), ("5\\% x % y", "5\\% x "), ("%all", ""), ("x\\\\% y", "x\\\\% y"), ("\\%%c", "\\%"), ("a\r\nb\n", "a\nb")])
def test_comments(spark, raw, expected):
    assert one(spark, T.strip_comments("t"), t=raw) == expected


@pytest.mark.parametrize(("raw", "limit", "expected"), [("a b\nc d\ne f", 5, "a b\nc d"), ("a b c d e f", 3, ""), ("ok", 9, "ok")])
def test_bound_text(spark, raw, limit, expected):
    assert one(spark, T.bound_text("t", limit), t=raw) == expected == fold.bounded(raw, limit)


def test_bound_list(spark):
    items = [" ".join(["w"] * 20), "\n".join([" ".join(["v"] * 10)] * 8), "z"]
    for limit in (80, 50, 10, 500):
        got = one(spark, T.bound_list("t", limit), t=items)
        assert got == fold.bounded_list(items, limit)
    assert len(one(spark, T.bound_list("t", 80), t=items)[1].split("\n")) == 5
    assert one(spark, T.bound_list("t", 50), t=items) == items[:1]


def test_sections(spark):
    text = "LOCAL_SUMMARY:\nx\nIMPORTANT_CLAIMS_RESULTS:\ny"
    for name, expected in (("LOCAL_SUMMARY", "x"), ("MEMORY_DELTA", ""), ("RESULTS", "y")):
        assert one(spark, T.extract_section("t", name), t=text) == expected == fold.section(text, name)
    assert one(spark, T.extract_section("t", "RESULTS", anchored=True), t=text) == ""
    for raw, useful in (("None ", False), ("N/A", False), ("no new durable facts", False), ("", False), ("none.", True), ("fact", True)):
        assert one(spark, T.useful_delta("t"), t=raw) is useful
    assert one(spark, T.append_delta(F.col("m"), F.lit(3), F.col("d")), m="M \n", d=" d ") == "M\n\nChunk 3 durable additions:\nd"


def test_labels(spark):
    label = lambda title: one(spark, T.display_label(F.col("t"), F.lit(None).cast("string"), F.lit("")), t=title)
    assert label("x" * 96) == "x" * 96
    assert label("x" * 97) == "x" * 95 + "..."
    assert label("  a \n b ") == "a b"
    assert label("") == "(untitled)"


@pytest.fixture(scope="module")
def paper(spark):
    files = spark.createDataFrame([("p", "main.tex", PAPER)], "paper_id string, path string, text string")
    return source.expanded(files)


def weighted(spark, paper, status=None, mode=None):
    images_ = spark.createDataFrame([("p", "fig/one.png")], "paper_id string, path string")
    flat = latex.flat_nodes(paper)
    nodes = latex.nodes(paper, source.resolve_images(flat, images_))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("node_order")]
    nodes = nodes.withColumn("own_tokens", F.coalesce(weight, F.lit(0)).cast("long")).drop("token_count")
    for column, values in (("include_status", status or {}), ("digest_mode", mode or {})):
        for order, value in values.items():
            nodes = nodes.withColumn(column, F.when(F.col("node_order") == order, value).otherwise(F.col(column)))
    return tree.totals(nodes)


def test_paper_tree(spark, paper):
    rows = weighted(spark, paper).orderBy("node_order").collect()
    assert [(r.node_order, r.parent_order, r.node_type, r.include_status) for r in rows] == [
        (0, None, "paper", "include"), (1, 0, "metadata", "include"), (2, 0, "abstract", "include"), (3, 0, "paragraph", "exclude"), (4, 0, "section", "include"), (5, 4, "paragraph", "include"), (6, 4, "paragraph", "include"),
        (7, 4, "subsection", "include"), (8, 7, "figure", "include"), (9, 7, "paragraph", "include"), (10, 7, "subsubsection", "include"), (11, 10, "paragraph", "include"), (12, 0, "section", "include"), (13, 12, "bibliography", "exclude"),
    ]
    assert rows[0].title == "A Tiny Paper" and rows[8].title == "A bold caption"
    assert rows[8].labels == ["fig:one"] and rows[8].image_paths == ["fig/one.png"]
    assert rows[5].text == "First paragraph with 5% noise." and rows[1].text == "title: A Tiny Paper\nauthor: A. Writer"
    text = paper.head().text
    assert text[rows[8].source_start : rows[8].source_end].startswith("\\begin{figure}")


@pytest.mark.parametrize(
    ("status", "mode", "limit", "top", "units", "totals"),
    [
        ({}, {}, 6550, False, [1, 2, 5, 6, 7], [95, 77, 42, 7, 0]), ({}, {}, 40, False, [1, 2, 5, 6, 8, 9, 11], [95, 77, 42, 7, 0]), ({}, {7: "split"}, 6550, False, [1, 2, 5, 6, 8, 9, 11], [95, 77, 42, 7, 0]),
        ({}, {4: "whole"}, 6550, False, [1, 2, 4], [95, 77, 42, 7, 0]), ({}, {}, 6550, True, [1, 2, 4, 12], [95, 77, 42, 7, 0]), ({4: "exclude"}, {}, 6550, False, [1, 2], [18, 77, 42, 7, 0]),
        ({7: "exclude"}, {}, 6550, False, [1, 2, 5, 6], [53, 35, 42, 7, 0]), ({8: "exclude"}, {}, 6550, False, [1, 2, 5, 6, 7], [65, 47, 12, 7, 0]),
    ],
)
def test_plans(spark, paper, status, mode, limit, top, units, totals):
    nodes = weighted(spark, paper, status, mode)
    counts = {r.node_order: r.token_count for r in nodes.collect()}
    assert [counts[k] for k in (0, 4, 7, 10, 12)] == totals
    nodes = chunking.top_level(nodes) if top else nodes
    assert [r.node_order for r in chunking.units(chunking.decisions(nodes, limit)).orderBy("chunk_index").collect()] == units


def test_plan_error(spark, paper):
    bad = chunking.errors(chunking.decisions(chunking.top_level(weighted(spark, paper)), 70), 70).collect()
    assert [r.message for r in bad] == ["Node 0004 was marked whole but has 77 tokens, over the chunk text limit 70."]


def test_random_trees(spark):
    """Windows against a stack; totals and plans against recursion."""
    rng = random.Random(5)
    rows, expected = [], {}
    for p in range(25):
        stack, nodes = [(-1, 0)], [{"o": 0, "kids": [], "leaf": False, "own": 0, "type": "paper", "path": [0], "ex": False, "mode": "auto"}]
        rows.append((p, 0, None, "paper", False, 0, "include", "auto"))
        for o in range(1, rng.randint(2, 30)):
            rank = rng.choice([None, None, 0, 1, 2, 3, 4])
            if rank is not None:
                while stack[-1][0] >= rank:
                    stack.pop()
            parent = stack[-1][1]
            kind = "paragraph" if rank is None else {0: "chapter", 1: "section", 2: "subsection", 3: "subsubsection", 4: "paragraph"}[rank]
            ex, mode, own = rng.random() < 0.15, rng.choice(["auto"] * 4 + ["whole", "split"]), rng.randint(0, 60)
            nodes.append({"o": o, "kids": [], "leaf": rank is None, "own": own, "type": kind, "path": [*nodes[parent]["path"], o], "ex": ex, "mode": mode})
            nodes[parent]["kids"].append(o)
            if rank is not None:
                stack.append((rank, o))
            rows.append((p, o, rank, kind, rank is None, own if rank is None else 0, "exclude" if ex else "include", mode))

        def total(n, nodes=nodes):
            n["total"] = n["own"] if n["leaf"] else sum(0 if nodes[k]["ex"] else total(nodes[k]) for k in n["kids"])
            for k in n["kids"]:
                total(nodes[k])
            return n["total"]

        def walk(n, out, nodes=nodes):
            if n["ex"]:
                return
            whole = n["type"] != "paper" and n["mode"] == "whole"
            if whole and n["total"] > 90:
                out.append(("error", n["o"]))
            elif whole or n["leaf"] or (n["mode"] == "auto" and n["type"] == "subsection" and n["total"] <= 90):
                out.append(("emit", n["o"]))
            else:
                for k in n["kids"]:
                    walk(nodes[k], out)

        total(nodes[0])
        out = []
        walk(nodes[0], out)
        expected[p] = (nodes, out)
    df = spark.createDataFrame(rows, "paper_id int, node_order int, rank int, node_type string, is_leaf boolean, own_tokens long, include_status string, digest_mode string")
    df = df.withColumns({"title": F.lit("t"), "caption": F.lit(None).cast("string"), "text": F.lit("")})
    nodes = tree.totals(tree.parents(df))
    for r in nodes.collect():
        n = expected[r.paper_id][0][r.node_order]
        assert (r.path, r.token_count) == (n["path"], n["total"])
    decided = chunking.decisions(nodes, 90)
    got = {(r.paper_id, "emit", r.node_order) for r in chunking.units(decided).collect()} | {(r.paper_id, "error", r.node_order) for r in chunking.errors(decided, 90).collect()}
    assert got == {(p, kind, o) for p, (_, out) in expected.items() for kind, o in out}


def test_sources(spark, tmp_path):
    doc = "\\begin{document}"
    files = [("a", "a/main.tex", doc), ("a", "ms.tex", doc), ("b", "a/b/main.tex", doc), ("b", "paper.tex", doc), ("c", "z.tex", "x"), ("c", "b.tex", "y")]
    found = source.main_files(spark.createDataFrame(files, "paper_id string, path string, text string"))
    assert {r.paper_id: r.main_file for r in found.collect()} == {"a": "ms.tex", "b": "paper.tex", "c": "b.tex"}
    assert source.expand({"m.tex": "\\input{x}\\input{x}", "x.tex": "X"}, "m.tex") == "\nX\n\n\n"
    assert source.expand({"m.tex": "\\input{q}"}, "m.tex") == "\n[missing input: q]\n"
    assert source.expand({"m.tex": "\\input{v1.2}", "v1.2.tex": "V"}, "m.tex") == "\nV\n"
    archive = tmp_path / "p.tar.gz"
    with tarfile.open(archive, "w:gz") as tar:
        for name, data in (("main.tex", PAPER.encode()), ("fig/one.png", b"\x89"), ("../evil.tex", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    read = source.read_files(spark, str(archive))
    assert sorted(r.path for r in read.collect()) == ["fig/one.png", "main.tex"]
    assert latex.nodes(source.expanded(source.texts(read))).count() == 14
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "main.tex").write_text(PAPER)
    assert latex.nodes(source.expanded(source.texts(source.read_files(spark, str(folder))))).count() == 14
    with pytest.raises(ValueError):
        source.read_files(spark, str(tmp_path / "x.docx"))


def test_latex_to_text():
    assert latex.latex_to_text(r"A \textbf{bold} caf\'e, \"{o} 5\% --- ``q'' \cite{a} $x$ \alpha{} a\\b") == "A bold café, ö 5% — “q” [cite: a] x a\nb"
    kinds = [k for k, *_ in latex.cut(r"a \begin{center}\begin{figure}x\end{figure}\end{center} \begin{verbatim}\section{no}\end{verbatim} \section*{Yes} {\section{no}}")]
    assert kinds == ["prose", "section", "prose"]


def test_prompts_agree(spark):
    texts, memory = ["one two\nthree", "x " * 200], "Running abstract: m"
    for safe in (200, 330, 1000):
        row = spark.createDataFrame([(memory, texts)], "m string, s array<string>").select(prompts.ladder(F.col("m"), F.lit("short"), F.col("s"), F.col("s"), F.array().cast("array<string>"), safe=safe).alias("l")).head().l
        try:
            expected = fold.final_that_fits(fold.ExtractiveRuntime(), memory, texts, texts, [], DigestionLimits(), safe)
        except ValueError:
            expected = None
        assert (row.prompt is None) == (expected is None)
        if row.step in range(1, 5):
            assert row.prompt == expected
    assert one(spark, count_tokens("t"), t="a_b, c!") == 5 == count_tokens_py("a_b, c!")
    stats = prompts.prompt_stats(F.lit("p"), F.lit("t"), F.lit("m"), F.array(F.lit("n")), F.lit(2), F.lit(0), safe=10)
    with pytest.raises(Exception, match="exceeds the safe prompt budget"):
        one(spark, prompts.checked_prompt(F.lit("p"), stats, F.lit(1)))


def test_fold_resumes():
    chunks = [(i, f"Head {i}\n" + f"A long line of facts number {i} " * 5, []) for i in range(1, 5)]
    whole = fold.digest_paper(chunks, fold.ExtractiveRuntime(), DigestionLimits(), 7800)
    first = fold.digest_paper(chunks[:2], fold.ExtractiveRuntime(), DigestionLimits(), 7800)
    rest = fold.digest_paper(chunks[2:], fold.ExtractiveRuntime(), DigestionLimits(), 7800, first["memory"], first["summaries"], first["deltas"])
    assert {k: rest[k] for k in ("memory", "summaries", "deltas", "final")} == {k: whole[k] for k in ("memory", "summaries", "deltas", "final")}
    images_ = fold.digest_paper([(1, "text", ["a.png", "b.png"])], fold.ExtractiveRuntime(), DigestionLimits(), 7800)
    assert images_["notes"] == ["Chunk 1 image 1 (a.png): a.png", "Chunk 1 image 2 (b.png): b.png"]
    failed = fold.digest_paper([chunks[0], (2, "w " * 9000, [])], fold.ExtractiveRuntime(), DigestionLimits(), 7800)
    assert failed["completed"] == 1 and "Chunk 2 exceeds" in failed["error"]


@pytest.mark.parametrize(
    ("events", "chunks", "run"),
    [
        ([("run_started", None)], ["pending", "pending"], "running"), ([("run_started", None), ("chunk_started", 1), ("chunk_completed", 1)], ["complete", "pending"], "running"),
        ([("run_started", None), ("chunk_started", 1), ("chunk_completed", 1), ("chunk_started", 2), ("chunk_failed", 2)], ["complete", "failed"], "failed"),
        ([("run_started", None), ("chunk_started", 1), ("chunk_interrupted", 1)], ["interrupted", "pending"], "interrupted"),
        ([("run_started", None), ("chunk_started", 1), ("chunk_completed", 1), ("chunk_started", 2), ("chunk_completed", 2), ("final_started", None), ("run_completed", None)], ["complete", "complete"], "complete"),
    ],
)
def test_log_to_state(spark, events, chunks, run):
    log = spark.createDataFrame([("r", i, e, c) for i, (e, c) in enumerate(events)], "run_id string, seq long, event string, chunk long")
    plan = spark.createDataFrame([("r", 1), ("r", 2)], "run_id string, chunk long")
    assert [r.status for r in runs.chunk_states(log, plan).orderBy("chunk").collect()] == chunks
    assert runs.run_states(log).head().status == run


@pytest.mark.parametrize(("old", "new", "prefix"), [(["1", "2", "5", "6"], ["1", "2", "4"], 2), (["1", "2"], ["1", "2", "3"], 2), (["9"], ["1", "2"], 0), (["1", "2"], ["1", "2"], 2)])
def test_resume(spark, old, new, prefix):
    make = lambda xs: spark.createDataFrame([("r", i, x) for i, x in enumerate(xs, 1)], "run_id string, place long, signature string")
    r = runs.resume_prefix(make(old), make(new)).head()
    assert (r.prefix, r.resume_at) == (prefix, prefix + 1)


def test_log_stream_file(spark, tmp_path):
    from quillspark.streaming import log as stream

    rows = spark.createDataFrame([("r", 1, "run_started", None), ("r", 2, "chunk_completed", 1), ("r", 3, "run_completed", None)], "run_id string, seq long, event string, chunk long").withColumn("time", F.current_timestamp())
    sinks.append_events(rows, str(tmp_path / "log"))
    got = []
    stream.start_status(stream.read_log(spark, str(tmp_path / "log")), lambda df, _: got.append(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert got[-1][0].status == "complete" and got[-1][0].last_completed_chunk == 1


def test_sinks(spark, tmp_path):
    done = spark.createDataFrame([("p", ["s1", "s2"], " end ")], "paper_id string, summaries array<string>, final string")
    assert sinks.markdown(done).head().text == "# Paper Digestion\n\n## Chunk 1\n\ns1\n\n## Chunk 2\n\ns2\n\n## Final\n\n end \n"
    final = sinks.final_product(done)
    assert final.head().text == "# Final Product\n\nend\n"
    sinks.write_texts(final, str(tmp_path / "out"))
    assert next((tmp_path / "out/paper_id=p").glob("*.txt")).read_text() == "# Final Product\n\nend\n"


def test_images(spark):
    assert not images.fit_to_square(np.zeros((100, 100, 3), np.uint8)).any()
    tall = images.fit_to_square(np.zeros((400, 200, 3), np.uint8))
    assert (tall[:, :224] == 255).all() and (tall[:, 672:] == 255).all() and not tall[:, 224:672].any()
    square = images.fit_to_square(np.zeros((200, 400, 3), np.uint8))
    assert square.shape == (896, 896, 3) and (square[:224] == 255).all() and (square[672:] == 255).all() and not square[224:672].any()
    assert images.checked([square]).shape == (1, 896, 896, 3) and images.checked([]) is None
    with pytest.raises(ValueError):
        images.checked(np.zeros((4, 4)))
    row = images.load(spark.createDataFrame([("a/x.png", bytearray(b"junk"))], "path string, content binary")).head()
    assert row.skipped == "x.png: image could not be rendered or read"


def test_snapshot_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda s: spark.createDataFrame([("r", s)], "run_id string, state string")
    with pytest.raises(FileNotFoundError):
        sinks.read_snapshots(spark, path)
    for s in ("one", "two", "three"):
        sinks.write_snapshots(rows(s), path)
        assert [r.state for r in sinks.read_snapshots(spark, path).collect()] == [s]
    assert len(sinks._versions(spark, path)) == 2


def test_plan_raises_and_lists(spark):
    nodes = spark.createDataFrame([("p", 0, "paper", None, False, "auto", 0), ("p", 1, "section", 1, False, "whole", 0), ("p", 2, "paragraph", None, True, "auto", 90)], "paper_id string, node_order int, node_type string, rank int, is_leaf boolean, digest_mode string, own_tokens long")
    nodes = tree.totals(tree.parents(nodes.withColumn("include_status", F.lit("include"))))
    with pytest.raises(Exception, match="Node 0001 was marked whole but has 90 tokens"):
        chunking.plan(nodes, TokenBudget(usable_input_tokens=1250 + 50)).count()
    assert chunking.plan(nodes, TokenBudget(usable_input_tokens=1250 + 90)).count() == 1
    out = chunking.outcomes(chunking.decisions(nodes, 50), 50).collect()
    assert [(r.node_order, r.chunk_index) for r in out] == [(1, None)] and out[0].message.startswith("Node 0001")
