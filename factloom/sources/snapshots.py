"""Stored snapshots, plans and SQL files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph

FORMAT = 1


@dataclass
class Snapshot:
    """Facts, edges and roll-ups of one state."""

    facts: DataFrame
    edges: DataFrame
    rolled: DataFrame
    root: str | None


def write(facts: DataFrame, edges: DataFrame, path: str, format: str = "parquet") -> str | None:
    """Write a snapshot with its roll-ups and root hash (``parquet`` or ``json``); give the root hash."""
    spark = facts.sparkSession
    rolled = graph.rollups(facts, edges)
    root = graph.root_hash(rolled).first()[0]
    for name, df in (("facts", facts), ("edges", edges), ("rollups", rolled)):
        df.write.format(format).save(f"{path}/{name}")
    spark.createDataFrame([(FORMAT, format, root)], "version int, format string, root string").coalesce(1).write.json(f"{path}/meta")
    return root


FACTS = "id string, kind string, parent_id string, payload map<string,string>, hash string, ref_only boolean"
EDGES = "from_id string, to_id string, edge_kind string"
ROLLUPS = "id string, parent_id string, depth int, rollup string, structural string"


def read(spark: SparkSession, path: str, verify: bool = True) -> Snapshot:
    """The snapshot at ``path``; its root hash is computed again, and a difference raises."""
    meta = spark.read.schema("version int, format string, root string").json(f"{path}/meta").first()
    if meta["version"] != FORMAT:
        raise ValueError(f"snapshot of version {meta['version']}")
    facts, edges, rolled = (spark.read.format(meta["format"]).schema(s).load(f"{path}/{n}") for n, s in (("facts", FACTS), ("edges", EDGES), ("rollups", ROLLUPS)))
    if verify:
        found = graph.root_hash(graph.rollups(facts, edges)).first()[0]
        if found != meta["root"]:
            raise ValueError(f"snapshot {path} has root {found}, not {meta['root']}")
    return Snapshot(facts, edges, rolled, meta["root"])


def write_plan(placed: DataFrame, path: str) -> None:
    """The plan as JSON lines in the order of ``position``."""
    placed.orderBy("position").write.json(path)


def write_scripts(scripts: DataFrame, path: str) -> None:
    """``scripts(file, text)``: one folder per file name, one text a row."""
    scripts.select(F.col("file").alias("name"), "text").write.partitionBy("name").option("lineSep", "\n").text(path)


def discover(spark: SparkSession, folder: str, pattern: str = "*.sql") -> DataFrame:
    """``file, sql`` of the files below ``folder``; ``file`` is the path inside it.  Whole files, each once."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    root = folder.rstrip("/").split(":")[-1].lstrip("/")
    return found.select(F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{root}/", "").alias("file"), F.col("value").alias("sql")).distinct()
