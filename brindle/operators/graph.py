"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}
#: Up to this many edges a round of contractions is planned as one job.
SMALL = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset and all runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or _fallback.get("dir")
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _fallback["dir"] = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/") + "/brindle"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table on shared storage: lineage ends here, and both sides of a later join are plain scans."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = [path]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that no plan reads any more; other DataFrames are left alone."""
    for df in tables:
        for path in getattr(df, "written_at", []):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _star(edges: DataFrame, large: bool, step: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One contraction.  Large: every larger neighbour of a node goes to the least node around; small: the others do.

    `step` writes an intermediate table, or leaves it in the plan.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = step(both, "star-edges")
    least = step(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    each = both.join(least, "u")
    if large:
        out = each.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = each.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge table (a, b); a component is named by its least node.

    Self-loops and repeated edges are harmless; null ends are dropped; nodes without an edge to another node are not
    returned.  Each round is two grouped minima and two equi-joins over tables on shared storage; a node with very many
    neighbours is a skewed key of a join between two scans, which adaptive execution splits.  The result reads one table,
    which `discard` deletes once the result is written elsewhere.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    seen = None
    for _ in range(max_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        # Few edges need no splitting of skewed joins: a round is one job then, and the same contraction.
        step = written if mark[0] > SMALL else lambda df, _: df
        now, old = written(_star(step(_star(now, True, step), "components"), False, step), "components"), now
        discard(old)
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("b").agg(F.lit(1).alias("one")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    out = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    out.written_at = now.written_at
    return out
