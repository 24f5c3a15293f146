"""Actions as files: routes, cycles, order, manifests, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import file_name, id_kind, id_name, id_schema, id_target
from factloom.operators.graph import child_edges, condensation, cut, reach


def route(subject: Column) -> Column:
    """The file that a subject's statements go to: by schema and kind; satellites go with their target, columns with their table."""
    own = F.coalesce(id_target(subject), subject)
    kind, schema = id_kind(own), id_schema(own)
    own_name = F.when(kind.isin("column", "default", "constraint", "index", "trigger", "policy", "rule"), F.lit("tables")).otherwise(F.concat(kind, F.lit("s")))
    name = file_name(F.regexp_replace(F.lower(id_name(own)), r"[^a-z0-9_]+", "_"))
    return F.concat(F.coalesce(F.concat(F.lit("schemas/"), file_name(F.lower(schema)), F.lit("/")), F.lit("cluster/")), own_name, F.lit("/"), name, F.lit(".sql"))


def split_cycles(files: DataFrame, edges: DataFrame, late: Column) -> DataFrame:
    """``action, file`` where actions that close a cycle of files move to a file of their own.

    ``files(action, file, ...)``, ``edges(src, dst)`` between actions; ``late``: what
    may be split off, such as foreign keys, if its file lies on a cycle.
    """
    place = lambda n, f: files.select(F.col("action").alias(n), F.col("file").alias(f))
    links = cut(edges.join(place("src", "a"), "src").join(place("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    named, _ = condensation(links)
    cyclic = named.join(named.groupBy("component").count().where("count > 1"), "component").select(F.col("id").alias("file"), F.lit(True).alias("_cyclic"))
    moved = F.coalesce("_cyclic", F.lit(False)) & late
    return files.join(cyclic, "file", "left").select("action", F.when(moved, F.regexp_replace("file", r"\.sql$", "_fk.sql")).otherwise(F.col("file")).alias("file"))


def merged_cycles(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``file, merged``: files on a cycle become the first of them by name; others stay."""
    named, _ = condensation(edges)
    return files.join(named.select(F.col("id").alias("file"), "component"), "file", "left").select("file", F.coalesce("component", "file").alias("merged"))


def case_collisions(rows: DataFrame, name: str) -> DataFrame:
    """``folded, spellings, canonical, n``: names that differ in case only, and the spelling they get."""
    found = rows.groupBy(F.lower(name).alias("folded")).agg(F.count_distinct(name).alias("spellings"), F.min(name).alias("canonical"), F.count(F.lit(1)).alias("n"))
    return found.where("spellings > 1")


def classified(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, state``: created, updated, unchanged or stale, by content."""
    both = old.select("path", F.col("content").alias("o")).join(new.select("path", F.col("content").alias("n")), "path", "full")
    state = F.when(F.col("o").isNull(), "created").when(F.col("n").isNull(), "stale").when(F.col("o") == F.col("n"), "unchanged").otherwise("updated")
    return both.select("path", state.alias("state"))


def stale(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """What the new export has no more."""
    return old.join(new.select(key), key, "left_anti")


def load_order(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, position``: those of the manifest in its order, others behind, by name."""
    from factloom.operators.graph import numbered

    named = files.select("path").distinct().join(manifest.select("path", F.col("position").alias("_place")), "path", "left")
    return numbered(named, F.col("_place").asc_nulls_last(), "path").select("path", "position")


def seeds(facts: DataFrame, schemas: tuple[str, ...]) -> DataFrame:
    """``id, kind`` of the assumed schemas and all that lies in them: what an empty database needs first."""
    start = facts.where((F.col("kind") == "schema") & id_name(F.col("id")).isin(*schemas)).select("id")
    return facts.join(reach(start, child_edges(facts)), "id", "left_semi").select("id", "kind")


def lint(directives: DataFrame, files: DataFrame) -> DataFrame:
    """Directives ``(file, place, target)`` that name a file that is not there."""
    return directives.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("file", "place", "target")
