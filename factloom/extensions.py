"""Extensions and profiles: what a platform adds to extraction, rules and views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import canonical_text, content_hash
from factloom.operators.graph import union
from factloom.plans.rules import Rules
from factloom.storage import materialize


class Handler(Protocol):
    """What an extension keeps as rows of its own tables, as facts."""

    name: str
    intents: dict[str, int]

    def capture(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Facts, edges and diagnostics ``(code, id)`` of the extension's tables."""

    def precheck(self, tables: dict[str, DataFrame]) -> DataFrame:
        """``code, id`` of what keeps the extension from being taken over."""


@dataclass
class RowHandler:
    """A handler whose intents are rows: one fact of kind ``extensionIntent`` for each row of ``table``."""

    name: str
    table: str
    key: str
    attrs: tuple[str, ...]
    intent: str
    weight: int = 90
    parent: Callable[[DataFrame], object] | None = None

    @property
    def intents(self) -> dict[str, int]:
        return {self.intent: self.weight}

    def capture(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Null keys give a diagnostic; of repeated keys the least row counts, the others are reported."""
        rows = tables[self.table]
        ident = F.concat(F.lit(f"extensionIntent:{self.name}.{self.intent}."), F.col(self.key).cast("string"))
        payload = F.create_map(*[x for a in self.attrs for x in (F.lit(a), canonical_text(F.col(a).cast("string")))])
        named = rows.select(ident.alias("id"), payload.alias("payload"), F.lit(f"extension:{self.name}").alias("owner"))
        sized = named.where("id is not null").groupBy("id").agg(F.min(F.map_entries("payload")).alias("p"), F.count(F.lit(1)).alias("n"))
        facts = sized.select("id", F.lit("extensionIntent").alias("kind"), F.lit(None).cast("string").alias("parent_id"), F.map_from_entries("p").alias("payload"))
        facts = facts.withColumns({"hash": content_hash(F.col("payload")), "ref_only": F.lit(False)})
        edges = facts.select(F.col("id").alias("from_id"), F.lit(f"extension:{self.name}").alias("to_id"), F.lit("depends").alias("edge_kind"))
        lost = named.where("id is null").select(F.lit("intent_without_key").alias("code"), F.col("owner").alias("id"))
        return facts, edges, lost.unionByName(sized.where("n > 1").select(F.lit("intent_collision").alias("code"), "id"))

    def precheck(self, tables: dict[str, DataFrame]) -> DataFrame:
        return self.capture(tables)[2]


def cron_jobs(table: str = "jobs", key: str = "jobname") -> RowHandler:
    return RowHandler("pg_cron", table, key, ("schedule", "command"), "job")


def queues(table: str = "queues", key: str = "queue_name") -> RowHandler:
    return RowHandler("pgmq", table, key, ("is_partitioned", "is_unlogged"), "queue")


def secrets(table: str = "secrets", key: str = "name") -> RowHandler:
    """Secrets are known by name only; their values never become payload."""
    return RowHandler("vault", table, key, ("description",), "secret")


def partitioned_parents(table: str = "part_config", key: str = "parent_table") -> RowHandler:
    return RowHandler("pg_partman", table, key, ("partition_interval", "control"), "parent")


@dataclass
class Profile:
    """A platform: its handlers, its rules, its baseline and what it manages."""

    name: str
    handlers: tuple[Handler, ...] = ()
    rules: Rules = field(default_factory=Rules)
    assumed_schemas: tuple[str, ...] = ()
    assumed_roles: tuple[str, ...] = ()
    scope: str = "database"

    def planner_rules(self) -> Rules:
        """The rules with the weights of the handlers' intents."""
        intents = {(h.name, kind): w for h in self.handlers for kind, w in h.intents.items()}
        return Rules(**{**self.rules.__dict__, "intents": {**self.rules.intents, **intents}})

    def capture(self, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
        """All handlers' facts, edges and diagnostics, in the handlers' order."""
        found = [h.capture(tables) for h in self.handlers]
        return tuple(materialize(union([f[i] for f in found]), "captured") for i in range(3))
