"""A corpus of books on disk: its configurations, its metric baseline, hashes of its files, and plug-ins of imprints."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASELINE = "config string, counter string, value double"


def discover_configs(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """path, workspace and stem of the files ``*/book*.yaml`` below folder but drafts; ``only`` names workspaces or workspace/stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "book*.yaml").load(f"{folder.rstrip('/')}/*").select("path")
    parts = F.split("path", "/")
    rows = files.select("path", F.element_at(parts, -2).alias("workspace"), F.regexp_replace(F.element_at(parts, -1), r"\.yaml$", "").alias("stem"))
    rows = rows.where(~F.contains("stem", F.lit("draft")))
    if only:
        rows = rows.where(F.col("workspace").isin(only) | F.concat_ws("/", "workspace", "stem").isin(only))
    return rows.orderBy("path")


def load_baseline(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """config, counter and value of a baseline file; one of another version, or none at all, has no rows."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", path.rsplit("/", 1)[1]).load(path.rsplit("/", 1)[0]).select(F.decode("content", "UTF-8").alias("t")).collect()
    data = json.loads(found[0]["t"]) if found else {}
    entries = data.get("entries", {}) if data.get("baseline_version") == version else {}
    rows = [(config, counter, float(value)) for config, entry in entries.items() for counter, value in entry.get("counters", {}).items()]
    return spark.createDataFrame(rows, BASELINE)


def hashes(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, size and sha256 of the files of a folder, hashed where they are read. Spark's source passes empty files over."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """Recorded files (name, sha256) that are missing or differ, with what is wrong."""
    both = recorded.select("name", F.col("sha256").alias("want")).join(found.select("name", "sha256"), "name", "left")
    return both.where("sha256 is null or sha256 <> want").select("name", F.when(F.col("sha256").isNull(), "missing or empty").otherwise("changed").alias("finding"))


_imprints: dict[str, Callable[[DataFrame], DataFrame]] = {}


def imprint(name: str):
    """Register a transformation of a book's blocks under an imprint's name."""

    def add(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        _imprints[name] = function
        return function

    return add


def apply_imprint(blocks: DataFrame, name: str | None) -> DataFrame:
    """Blocks as the imprint's plug-in leaves them; without a name as they are, an unknown name is an error."""
    if not name:
        return blocks
    if name not in _imprints:
        raise ValueError(f"no imprint {name!r}; there are {sorted(_imprints)}")
    return blocks.transform(_imprints[name])
