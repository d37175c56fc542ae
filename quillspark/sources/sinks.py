"""Sinks: Markdown of a run, the final product, the event log and state snapshots. A file a paper, written on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(results: DataFrame, resumed: bool = False) -> DataFrame:
    """``paper_id, text``: header, a block for each chunk in order, the final digest."""
    blocks = F.transform("summaries", lambda s, i: F.concat(F.lit("## Chunk "), (i + 1).cast("string"), F.lit("\n\n"), s, F.lit("\n\n")))
    head = F.lit("# Resume\n\n" if resumed else "# Paper Digestion\n\n")
    return results.select("paper_id", F.concat(head, F.array_join(blocks, ""), F.lit("## Final\n\n"), F.coalesce("final", F.lit("")), F.lit("\n")).alias("text"))


def final_product(results: DataFrame) -> DataFrame:
    """``paper_id, text`` of the final file; only papers that have a final digest."""
    own = F.regexp_replace("final", r"^\s+|\s+$", "")
    return results.where(F.coalesce(own, F.lit("")) != "").select("paper_id", F.concat(F.lit("# Final Product\n\n"), own, F.lit("\n")).alias("text"))


def write_texts(texts: DataFrame, path: str, mode: str = "append") -> None:
    """A folder a paper, one text file each. The line end that closes every text is the writer's."""
    texts.select("paper_id", F.regexp_replace("text", r"\n\z", "").alias("value")).write.mode(mode).partitionBy("paper_id").text(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path
    return to, to(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_snapshots(snapshots: DataFrame, path: str) -> str:
    """Writes a new version beside the old ones, then names it by one rename; a reader never sees half a version.

    The version before stays for readers that have begun; older ones are deleted. Returns the version's name.
    """
    spark = snapshots.sparkSession
    to, fs = _fs(spark, path)
    old = _versions(spark, path)
    name = f"v{(int(old[-1][1:]) if old else 0) + 1:012d}"
    snapshots.write.mode("overwrite").json(f"{path}/_new-{name}")
    if not fs.rename(to(f"{path}/_new-{name}"), to(f"{path}/{name}")):
        raise OSError(f"{path}/{name} could not be put in place")
    for gone in old[:-1]:
        fs.delete(to(f"{path}/{gone}"), True)
    return name


def _versions(spark: SparkSession, path: str) -> list[str]:
    to, fs = _fs(spark, path)
    if not fs.exists(to(path)):
        return []
    return sorted(n for n in (f.getPath().getName() for f in fs.listStatus(to(path))) if n.startswith("v"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, state`` of the latest version."""
    have = _versions(spark, path)
    if not have:
        raise FileNotFoundError(f"no snapshots at {path}")
    return spark.read.schema("run_id string, state string").json(f"{path}/{have[-1]}")
