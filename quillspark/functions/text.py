"""Text operators on columns. Patterns keep to what Java's and Google's engines read alike, where they can."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import TokenCounter, count_tokens

# Names and marks of the format.
SECTION_MARKS = [
    "LOCAL_SUMMARY:", "MEMORY_DELTA:", "UPDATED_ROLLING_MEMORY:", "COMPACTED_ROLLING_MEMORY:", "DETAILED_DIGEST:", "KEY_CONTRIBUTIONS:", "METHOD_AND_ARCHITECTURE:", "TRAINING_AND_EVALUATION:",
    "RESULTS:", "FIGURES_AND_TABLES:", "LIMITATIONS_AND_FUTURE_WORK:", "SHORT_SUMMARY:", "IMPORTANT_CLAIMS_RESULTS:", "LIMITATIONS_OR_UNCERTAINTIES:", "FIGURES_TABLES_USED:", "IMAGE_SUMMARY:",
]
USELESS_DELTAS = ["", "none", "n/a", "no new durable facts"]
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".pdf"]
REFERENCE_MACROS = ["ref", "eqref", "autoref", "pageref", "cite", "citep", "citet"]

LINE_ENDS = r"\r\n|[\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
REFERENCE = r"\\(" + "|".join(REFERENCE_MACROS) + r")\{([^}]+)\}"
LABEL = r"\\label\{([^}]+)\}"
GROUP = r"(?:\[[^\]]*\])?\{((?:[^{}]|\{[^{}]*\})*)\}"
GRAPHICS = r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}"
ABSTRACT = r"(?s)\\begin\{abstract\}(.*?)\\end\{abstract\}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (trim takes spaces only)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def lines(text: Column | str) -> Column:
    """Lines as ``splitlines`` gives them: all line ends, no last empty line, none for empty text."""
    t = F.regexp_replace(F.regexp_replace(_c(text), LINE_ENDS, "\n"), r"\n\z", "")
    return F.when(_c(text) == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))


def strip_comments(text: Column | str) -> Column:
    """Each line up to its first percent sign that no backslash precedes."""
    return F.array_join(F.transform(lines(text), lambda s: F.regexp_replace(s, r"(?<!\\)%.*", "")), "\n")


def document_body(text: Column | str) -> Column:
    t = _c(text)
    begin, end = F.locate("\\begin{document}", t), F.locate("\\end{document}", t)
    start = begin + len("\\begin{document}")
    inner = F.when(end > 0, F.substring(t, start, F.greatest(end - start, F.lit(0)))).otherwise(F.substring(t, start, F.length(t)))
    return F.when(begin > 0, inner).otherwise(t)


def first_group(text: Column | str, command: str) -> Column:
    """Value of the first ``\\command[..]{value}``, one nested brace level; null without."""
    pattern = rf"(?s)\\{command}{GROUP}"
    return F.when(F.regexp_like(_c(text), F.lit(pattern)), F.regexp_extract(_c(text), pattern, 1))


def abstract(body: Column | str) -> Column:
    return F.when(F.regexp_like(_c(body), F.lit(ABSTRACT)), F.regexp_extract(_c(body), ABSTRACT, 1))


def without_abstracts(body: Column | str) -> Column:
    return F.regexp_replace(_c(body), ABSTRACT, "")


def normalize_refs(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), REFERENCE, "[$1: $2]")


def tidy(text: Column | str) -> Column:
    """The white-space rules that follow conversion."""
    t = F.regexp_replace(_c(text), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\s+\n", "\n"))


def labels(raw: Column | str) -> Column:
    return F.regexp_extract_all(_c(raw), F.lit(LABEL), 1)


def references(raw: Column | str) -> Column:
    return F.regexp_extract_all(_c(raw), F.lit(REFERENCE), 2)


def reference_keys(refs: Column | str) -> Column:
    """Single keys of references that name several, split at commas."""
    return F.flatten(F.transform(_c(refs), lambda r: F.transform(F.split(r, ","), strip)))


def caption(raw: Column | str) -> Column:
    return first_group(raw, "caption")


def graphics(raw: Column | str) -> Column:
    return F.regexp_extract_all(_c(raw), F.lit(GRAPHICS), 1)


def base_environment(env: Column | str) -> Column:
    e = F.regexp_replace(_c(env), r"\*$", "")
    return F.when(e == "thebibliography", F.lit("bibliography")).otherwise(e)


def block_title(caption_: Column | str, labels_: Column | str, env: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(caption_), F.lit("")), F.nullif(F.try_element_at(_c(labels_), F.lit(1)), F.lit("")), base_environment(env))


def _images(paths: Column) -> Column:
    names = F.array_join(F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1)), ", ")
    return F.when(F.size(paths) > 0, F.concat(F.lit("Images: "), names))


def model_text(caption_: Column, image_paths: Column, text: Column) -> Column:
    return strip(F.concat_ws("\n\n", F.concat(F.lit("Caption: "), F.nullif(caption_, F.lit(""))), _images(image_paths), F.nullif(text, F.lit(""))))


def selectable_text(node_type: Column, title: Column, caption_: Column, image_paths: Column, text: Column) -> Column:
    head = F.concat(F.upper(node_type), F.lit(": "), F.nullif(title, F.lit("")))
    return strip(F.concat_ws("\n\n", head, F.concat(F.lit("Caption: "), F.nullif(caption_, F.lit(""))), _images(image_paths), F.nullif(text, F.lit(""))))


def display_label(title: Column, caption_: Column, text: Column, most: int = 96) -> Column:
    first = F.coalesce(F.nullif(title, F.lit("")), F.nullif(caption_, F.lit("")), F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "), 1, 48))
    one = strip(F.regexp_replace(first, r"\s+", " "))
    long = F.concat(F.regexp_replace(F.substring(one, 1, most - 1), r"\s+$", ""), F.lit("..."))
    return F.when(one == "", F.lit("(untitled)")).when(F.length(one) <= most, one).otherwise(long)


def heading(node_order: Column, node_type: Column, title: Column, label: Column) -> Column:
    """Empty for prose paragraphs."""
    return F.when((node_type == "paragraph") & (title == "paragraph"), F.lit("")).otherwise(F.format_string("[%04d] %s - %s", node_order, F.upper(node_type), label))


def extract_section(text: Column | str, name: str, anchored: bool = False) -> Column:
    """Text after the first ``NAME:`` to the next known mark; empty without it. anchored: marks at line starts only."""
    t = _c(text)
    mark = f"{name}:"
    if anchored:
        at = F.when(F.startswith(t, F.lit(mark)), F.lit(1)).otherwise(F.coalesce(F.nullif(F.locate("\n" + mark, t), F.lit(0)) + 1, F.lit(0)))
    else:
        at = F.locate(mark, t)
    rest = F.substring(t, at + len(mark), F.length(t))
    ends = [F.nullif(F.locate(("\n" if anchored else "") + m, rest), F.lit(0)) for m in SECTION_MARKS]
    cut = F.coalesce(F.least(*ends), F.length(rest) + 1)
    return F.when(at > 0, strip(F.substring(rest, F.lit(1), cut - 1))).otherwise(F.lit(""))


def useful_delta(delta: Column | str) -> Column:
    return ~F.lower(strip(F.coalesce(_c(delta), F.lit("")))).isin(USELESS_DELTAS)


def append_delta(memory: Column, chunk_index: Column, delta: Column) -> Column:
    added = F.concat(F.regexp_replace(memory, r"\s+$", ""), F.lit("\n\nChunk "), chunk_index.cast("string"), F.lit(" durable additions:\n"), strip(delta))
    return F.when(strip(F.coalesce(delta, F.lit(""))) == "", memory).otherwise(added)


def bound_text(text: Column | str, limit: Column | int, counter: TokenCounter = count_tokens) -> Column:
    """The text if it fits, else its longest run of whole lines from the start that fits, stripped.

    Running counts of the lines give every prefix's count in one pass: a prefix costs its lines' tokens and
    the begin mark once. So this form needs a counter that adds up over lines, as the default does.
    """
    t, most = _c(text), F.lit(limit) if isinstance(limit, int) else limit
    own = F.transform(lines(t), lambda s: F.struct(s.alias("s"), F.greatest(counter(s) - 1, F.lit(0)).cast("long").alias("n")))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open"))

    def step(acc, line):
        total = acc["n"] + line["n"]
        fits = acc["open"] & (F.when(total > 0, total + 1).otherwise(0) <= most)
        return F.struct(total.alias("n"), (acc["k"] + fits.cast("int")).alias("k"), fits.alias("open"))

    kept = F.aggregate(own, start, step)["k"]
    return F.when(counter(t) <= most, t).otherwise(strip(F.array_join(F.slice(lines(t), F.lit(1), kept), "\n")))


def bound_list(items: Column | str, limit: Column | int, counter: TokenCounter = count_tokens, spare: int = 40) -> Column:
    """The longest run of items from the start whose join by blank lines fits; a bounded part of the next one, if over ``spare`` tokens are left.

    Counts add up over blank lines, so the items are counted once each.
    """
    x = F.coalesce(_c(items), F.array().cast("array<string>"))
    own = F.transform(x, lambda s: F.greatest(counter(s) - 1, F.lit(0)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(True).alias("open"))

    def step(acc, n):
        total = acc["n"] + n
        fits = acc["open"] & (F.when(total > 0, total + 1).otherwise(0) <= limit)
        return F.struct(F.when(fits, total).otherwise(acc["n"]).alias("n"), (acc["k"] + fits.cast("int")).alias("k"), fits.alias("open"))

    def cut(s):
        left = F.lit(limit) - F.when(s["n"] > 0, s["n"] + 1).otherwise(0)
        part = F.transform(F.slice(x, s["k"] + 1, F.lit(1)), lambda item: bound_text(item, left, counter))
        return F.concat(F.slice(x, F.lit(1), s["k"]), F.when(left > spare, part).otherwise(F.array().cast("array<string>")))

    return F.aggregate(own, start, step, cut)


def first_seen(items: Column | str) -> Column:
    return F.array_distinct(_c(items))


def chunk_title(labels_: Column) -> Column:
    first, last = F.element_at(labels_, 1), F.element_at(labels_, -1)
    return F.when(F.size(labels_) == 0, F.lit("(empty)")).when(F.size(labels_) == 1, first).otherwise(F.concat(first, F.lit(" -> "), last))
