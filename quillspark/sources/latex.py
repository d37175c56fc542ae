"""Sources of papers: LaTeX files, folders and archives; main file, includes and images.

Files are rows ``paper_id, path, text`` (path within the paper). Archives are unpacked in memory on executors.
"""

from __future__ import annotations

import io
import lzma
import re
import tarfile
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

INCLUDE = r"\\(?:input|include)\{([^}]+)\}"


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of archives, one row each. An archive that can't be read gives one row, ``path`` null and the message in ``content``."""
    names = ["paper_id", "path", "content"]
    row = lambda *v: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(v, (pa.string(), pa.string(), pa.binary()), strict=True)], names)
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with tarfile.open(fileobj=io.BytesIO(content or b""), mode="r:*") as tar:
                    for member in tar:
                        p = PurePosixPath(member.name)
                        if member.isfile() and not p.is_absolute() and ".." not in p.parts:
                            yield row(path, str(p), tar.extractfile(member).read())
            except (tarfile.TarError, OSError, EOFError, zlib.error, lzma.LZMAError) as e:
                yield row(path, None, f"unreadable archive: {e}".encode())


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``paper_id, path, content`` of an archive (``.tar.gz``), a ``.tex`` file, or a folder; globs read many papers.

    Any other suffix is a ValueError. A folder is one paper; with ``*/`` at its end each folder below is one.
    """
    if path.endswith((".tar.gz", ".tgz")):
        raw = spark.read.format("binaryFile").load(path).select("path", "content")
        return raw.mapInArrow(_unpacked, "paper_id string, path string, content binary")
    if path.endswith(".tex"):
        raw = spark.read.format("binaryFile").load(path)
        return raw.select(F.col("path").alias("paper_id"), F.element_at(F.split("path", "/"), -1).alias("path"), "content")
    if re.search(r"\.[A-Za-z0-9]+$", path):
        raise ValueError(f"not a LaTeX source: {path}")
    many = path.endswith("*/")
    root = path.rstrip("/*").rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    inner = F.regexp_extract("path", re.escape(root.split("://")[-1].rstrip("/")) + r"/(.*)$", 1)
    if many:
        return raw.select(F.regexp_extract(inner, r"^([^/]*)/", 1).alias("paper_id"), F.regexp_replace(inner, r"^[^/]*/", "").alias("path"), "content")
    return raw.select(F.lit(root).alias("paper_id"), inner.alias("path"), "content")


def texts(files: DataFrame) -> DataFrame:
    """``.tex`` files with their content as text; bytes that are no UTF-8 are replaced."""
    return files.where(F.lower("path").endswith(".tex")).select("paper_id", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def main_files(files: DataFrame) -> DataFrame:
    """The main file of each paper: with a document begin, ``ms.tex`` before others, fewer folders, then by name; else the first path."""
    has = F.contains(F.col("text"), F.lit("\\begin{document}"))
    name = F.element_at(F.split("path", "/"), -1)
    parts = F.size(F.split("path", "/"))
    order = [F.desc(has), F.when(has, (name != "ms.tex").cast("int")), F.when(has, parts), F.when(has, name), F.col("path")]
    ranked = files.withColumn("_r", F.row_number().over(Window.partitionBy("paper_id").orderBy(*order)))
    return ranked.where("_r = 1").select("paper_id", F.col("path").alias("main_file"))


def _joined(path: str, relative: str) -> str:
    out: list[str] = []
    for part in [*path.split("/")[:-1], *relative.split("/")]:
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def expand(files: dict[str, str], main: str) -> str:
    """The main file with all includes in place, without comments. A file is put in once; one that is missing leaves a mark.

    Works from a stack of what is still to be put out, so includes may be nested to any depth.
    """
    seen: set[str] = set()
    out: list[str] = []
    todo: list[tuple[str, str | None]] = [("", main)]  # a text and None, or where from and what is included
    while todo:
        path, name = todo.pop()
        if name is None:
            out.append(path)
            continue
        file = name if name.endswith(".tex") else name + ".tex"
        found = next((p for p in (_joined(path, file), _joined("", file)) if p in files), None) if path else main
        if found is None:
            out.append(f"\n[missing input: {name}]\n")
            continue
        around = "\n" if path else ""
        if found in seen:
            out.append(around * 2)
            continue
        seen.add(found)
        text = "\n".join(re.sub(r"(?<!\\)%.*", "", line) for line in files[found].splitlines())
        parts = re.split(INCLUDE, text)  # text, name, text, ...
        own = [(part, None) if k % 2 == 0 else (found, part.strip()) for k, part in enumerate(parts)]
        todo += reversed([(around, None), *own, (around, None)])
    return "".join(out)


def expanded(files: DataFrame, mains: DataFrame | None = None) -> DataFrame:
    """``paper_id, main_file, text`` by paper. Inclusion is recursive and depends on order, so a paper's files meet in one group."""
    mains = main_files(files) if mains is None else mains
    kind = files.schema["paper_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        main = pdf["main_file"].iloc[0]
        return pd.DataFrame({"paper_id": pdf["paper_id"].iloc[:1].to_numpy(), "main_file": [main], "text": [expand(dict(zip(pdf["path"], pdf["text"].fillna(""), strict=True)), main)]})

    return files.join(mains, "paper_id").groupBy("paper_id").applyInPandas(run, f"paper_id {kind}, main_file string, text string")


def resolve_images(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """``paper_id, node_order, image_paths``: graphics of nodes found among the paper's files, in order; others are left out.

    A path is sought in the source's folder, then at the root, as it stands (with a known extension) or with each
    extension in turn; last, anywhere as a prefix of a file's name.
    """
    known = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1))
    files = paths.withColumn("_ext", known).where(F.col("_ext").isin(T.IMAGE_EXTENSIONS)).select("paper_id", "path", "_ext")
    stem = F.regexp_replace("path", r"\.[A-Za-z0-9]+$", "")
    both = files.select("paper_id", "path", F.explode(F.array(F.struct(F.col("path").alias("key"), F.lit(-1).alias("e")), F.struct(stem.alias("key"), F.array_position(F.array(*map(F.lit, T.IMAGE_EXTENSIONS)), F.col("_ext")).cast("int").alias("e")))).alias("k")).select("paper_id", "path", F.col("k.key"), F.col("k.e"))
    folder = F.regexp_replace("source_path", r"[^/]*$", "")
    asked = nodes.select("paper_id", "node_order", folder.alias("folder"), F.posexplode("graphics").alias("i", "g")).withColumn("g", F.regexp_replace("g", r"^\./", ""))
    tries = asked.select("*", F.posexplode(F.array(F.concat("folder", "g"), F.col("g"))).alias("place", "key"))
    exact = tries.join(both, ["paper_id", "key"]).select("paper_id", "node_order", "i", "path", F.col("place").alias("p1"), F.col("e").alias("p2"))
    name = F.element_at(F.split("path", "/"), -1)
    loose = asked.join(files.select("paper_id", "path", name.alias("name")), "paper_id").where(F.startswith("name", F.element_at(F.split("g", "/"), -1))).select("paper_id", "node_order", "i", "path", F.lit(9).alias("p1"), F.lit(0).alias("p2"))
    best = exact.unionByName(loose).groupBy("paper_id", "node_order", "i").agg(F.min(F.struct("p1", "p2", "path")).alias("b"))
    return best.groupBy("paper_id", "node_order").agg(F.array_sort(F.collect_list(F.struct("i", F.col("b.path").alias("path")))).alias("x")).select("paper_id", "node_order", F.col("x.path").alias("image_paths"))
