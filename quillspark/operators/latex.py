"""LaTeX papers to node tables.

Cutting a body into sections, blocks and prose needs a scan that tracks braces and environments, so it runs in
Python over Arrow batches, a paper at a time; every other step is a DataFrame expression. The supported subset:
comments already removed, six section macros (starred and with optional arguments too), the block environments
at the top level, verbatim environments, nested environments and braces; other macros keep their arguments' text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import TokenCounter, count_tokens
from . import tree

_MARK = re.compile(r"\\(?:begin|end)\{([^}]*)\}|\\([A-Za-z]+)\*?|\\.|[{}]", re.S)
_VERBATIM = {"verbatim", "verbatim*", "lstlisting", "minted", "comment"}
_ARG = r"(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"
_REF = re.compile(T.REFERENCE)
_ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "=": "\u0304", ".": "\u0307", "v": "\u030c", "H": "\u030b"}
_SYMBOLS = {"ss": "ß", "ae": "æ", "AE": "Æ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "ldots": "...", "dots": "...", "textbackslash": "\\", "LaTeX": "LaTeX", "TeX": "TeX", "quad": " ", "qquad": "  "}
_DROPPED = {"label", "includegraphics", "vspace", "hspace", "bibliographystyle", "usepackage", "documentclass", "setlength"}


def latex_to_text(raw: str) -> str:
    """Readable text: references as ``[ref: x]``, arguments of unknown macros kept, escapes, dashes, quotes and accents resolved."""
    import unicodedata

    t = _REF.sub(r"[\1: \2]", raw)
    t = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]]*\])?", "", t)
    t = re.sub(r"\\(" + "|".join(_DROPPED) + r")\*?(?:\[[^\]]*\])?(?:\{[^{}]*\})*", "", t)
    t = re.sub(r"\\\\(?:\[[^\]]*\])?|\\newline\b ?", "\n", t)
    t = re.sub(r"\\(['`^\"~=.]|[cvH](?![A-Za-z]))\s*(?:\{(\\?[A-Za-z])\}|(\\?[A-Za-z]))", lambda m: unicodedata.normalize("NFC", (m[2] or m[3]).lstrip("\\") + _ACCENTS[m[1]]), t)
    t = re.sub(r"\\(" + "|".join(sorted(_SYMBOLS, key=len, reverse=True)) + r")(?![A-Za-z])(?:\{\}| )?", lambda m: _SYMBOLS[m[1]], t)
    t = re.sub(r"\\([%&_#${}])", lambda m: {"{": "\ue000", "}": "\ue001", "$": "\ue002"}.get(m[1], m[1]), t)
    t = re.sub(r"\\item\b(?:\[([^\]]*)\])? ?", lambda m: f"* {m[1]} " if m[1] else "* ", t)
    t = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])? ?", "", t)
    t = re.sub(r"\\[,;:! ]", " ", t)
    t = t.replace("---", "\u2014").replace("--", "\u2013").replace("``", "\u201c").replace("''", "\u201d").replace("~", " ")
    t = re.sub(r"[{}$]", "", t).translate({0xE000: "{", 0xE001: "}", 0xE002: "$"})
    t = re.sub(r"\s+\n", "\n", re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", t)))
    return t.strip()


def cut(body: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(kind, name, raw, start, end): ``section``, ``block`` and ``prose`` pieces of the top level, in order."""
    at = done = 0
    depth, opened = 0, []
    block: tuple[str, int] | None = None
    while m := _MARK.search(body, at):
        at = m.end()
        s = m[0]
        if s.startswith("\\begin"):
            if m[1] in _VERBATIM:
                close = body.find(f"\\end{{{m[1]}}}", at)
                at = len(body) if close < 0 else close + len(m[1]) + 6
                continue
            if not opened and depth == 0 and m[1] in tree.BLOCKS:
                if body[done : m.start()]:
                    yield "prose", "", body[done : m.start()], done, m.start()
                block = (m[1], m.start())
            opened.append(m[1])
        elif s.startswith("\\end{"):
            if m[1] in opened:
                while opened.pop() != m[1]:
                    pass
            if block and not opened:
                yield "block", block[0], body[block[1] : at], block[1], at
                done, block, depth = at, None, 0
        elif s in "{}":
            depth = max(0, depth + (1 if s == "{" else -1))
        elif m[2] in tree.SECTION_RANKS and not opened and depth == 0:
            arg = re.compile(r"\s*" + _ARG, re.S).match(body, at)
            if body[done : m.start()]:
                yield "prose", "", body[done : m.start()], done, m.start()
            at = arg.end() if arg else at
            yield "section", m[2], arg[1] if arg else m[2], m.start(), at
            done = at
    if block:
        yield "prose", "", body[block[1] :], block[1], len(body)
    elif body[done:]:
        yield "prose", "", body[done:], done, len(body)


def paragraphs(raw: str, start: int) -> Iterator[tuple[str, str, int, int]]:
    """(converted, raw, start, end) of blank-line separated paragraphs of 3 characters or more."""
    at = 0
    for part in [*re.finditer(r"\n\s*\n", raw), None]:
        end = part.start() if part else len(raw)
        text = latex_to_text(raw[at:end])
        if len(text) >= 3:
            yield text, raw[at:end], start + at, start + end
        at = part.end() if part else end


def _rows(text: str, main: str) -> Iterator[dict]:
    """Nodes of a paper in preorder, flat; offsets are into the expanded text."""
    group = lambda name: (m := re.search(rf"\\{name}{_ARG}", text, re.S)) and m[1]
    leaf = {"rank": None, "caption": None, "labels": [], "references": [], "graphics": [], "include_status": "include", "is_leaf": True}
    stem = main.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    yield leaf | {"node_type": "paper", "title": latex_to_text(group("title") or stem), "text": "", "source_start": None, "source_end": None, "is_leaf": False}
    meta = [f"{k}: {latex_to_text(v)}" for k in ("title", "author", "date") if (v := group(k))]
    if meta:
        yield leaf | {"node_type": "metadata", "title": "metadata", "text": "\n".join(meta), "source_start": 0, "source_end": 0}
    begin, end = text.find("\\begin{document}"), text.find("\\end{document}")
    first = begin + 16 if begin >= 0 else 0
    body = text[first : end if end >= 0 and begin >= 0 else None]
    abstracts = list(re.finditer(T.ABSTRACT[4:], body, re.S))
    if abstracts:
        a = abstracts[0]
        yield leaf | {"node_type": "abstract", "title": "abstract", "text": latex_to_text(a[1]), "labels": re.findall(T.LABEL, a[1]), "references": [r[1] for r in _REF.findall(a[1])], "source_start": first + a.start(), "source_end": first + a.end()}
    for a in abstracts:  # blanked, so that offsets stay
        body = body[: a.start()] + " " * (a.end() - a.start()) + body[a.end() :]
    for kind, name, raw, start, stop in cut(body):
        refs = {"labels": re.findall(T.LABEL, raw), "references": [r[1] for r in _REF.findall(raw)]}
        where = {"source_start": first + start, "source_end": first + stop}
        if kind == "section":
            yield leaf | where | {"node_type": name, "rank": tree.SECTION_RANKS[name], "title": latex_to_text(raw), "text": "", "is_leaf": False}
        elif kind == "block":
            env = name.rstrip("*")
            env = "bibliography" if env == "thebibliography" else env
            cap = (m := re.search(r"\\caption" + _ARG, raw, re.S)) and latex_to_text(m[1])
            title = cap or (refs["labels"] or [""])[0] or env
            yield leaf | refs | where | {"node_type": env, "title": title, "text": latex_to_text(raw), "caption": cap, "graphics": re.findall(T.GRAPHICS, raw), "include_status": "exclude" if env == "bibliography" else "include"}
        else:
            for converted, own, a, b in paragraphs(raw, first + start):
                yield leaf | {"node_type": "paragraph", "title": "paragraph", "text": converted, "labels": re.findall(T.LABEL, own), "references": [r[1] for r in _REF.findall(own)], "source_start": a, "source_end": b}


_FIELDS = "node_order int, node_type string, rank int, title string, text string, caption string, labels array<string>, references array<string>, graphics array<string>, source_start int, source_end int, is_leaf boolean, include_status string"


def flat_nodes(papers: DataFrame) -> DataFrame:
    """Nodes of ``paper_id, main_file, text`` (expanded, without comments), in preorder, without parents."""
    kind = papers.schema["paper_id"].dataType.simpleString()
    schema = f"paper_id {kind}, source_path string, {_FIELDS}"
    names = [f.name for f in papers.sparkSession.createDataFrame([], schema).schema][2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"labels": pa.list_(pa.string()), "references": pa.list_(pa.string()), "graphics": pa.list_(pa.string()), "is_leaf": pa.bool_(), "rank": pa.int32(), "node_order": pa.int32(), "source_start": pa.int32(), "source_end": pa.int32()}
        for batch in batches:
            for i in range(batch.num_rows):
                main, text = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or ""
                rows = [r | {"node_order": k} for k, r in enumerate(_rows(text, main))]
                ids = batch.column(0).take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([main] * len(rows), pa.string()), *(pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names)], ["paper_id", "source_path", *names])

    return papers.select("paper_id", "main_file", "text").mapInArrow(run, schema)


def nodes(papers: DataFrame, images: DataFrame | None = None, counter: TokenCounter = count_tokens) -> DataFrame:
    """The node table with parents, paths, front matter excluded, images resolved, own tokens and totals.

    images: ``paper_id, node_order, image_paths`` (see ``sources.latex.resolve_images``).
    """
    out = tree.parents(flat_nodes(papers))
    if images is not None:
        out = out.join(images, ["paper_id", "node_order"], "left")
    else:
        out = out.withColumn("image_paths", F.lit(None).cast("array<string>"))
    out = out.withColumns({"image_paths": F.coalesce("image_paths", F.array().cast("array<string>")), "digest_mode": F.lit("auto")})
    return tree.totals(tree.with_tokens(tree.front_matter(out), counter))


def missed_images(flat: DataFrame, papers: DataFrame) -> DataFrame:
    """``paper_id, missed``: images that stand outside block environments and so belong to no node."""
    seen = flat.groupBy("paper_id").agg(F.sum(F.size("graphics")).alias("seen"))
    return papers.select("paper_id", F.size(T.graphics("text")).alias("n")).join(seen, "paper_id").select("paper_id", (F.col("n") - F.col("seen")).alias("missed"))
