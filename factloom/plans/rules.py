"""Rules by kind and attribute as two small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rank of each kind among actions of one phase.
WEIGHTS = {
    "role": 0, "schema": 1, "membership": 1, "extension": 2, "fdw": 2, "sequence": 3, "server": 3, "table": 4, "userMapping": 4, "column": 5,
    "foreignTable": 5, "default": 6, "domain": 7, "type": 7, "typeAttribute": 7, "collation": 7, "function": 8, "procedure": 8, "aggregate": 9,
    "constraint": 10, "view": 12, "materializedView": 13, "index": 14, "rule": 15, "trigger": 15, "policy": 16, "eventTrigger": 17,
    "publication": 18, "publicationRel": 18, "publicationSchema": 18, "comment": 20, "securityLabel": 20, "acl": 21, "defaultPrivilege": 22,
    "subscription": 23, "extensionIntent": 90,
}
#: Kinds whose drop takes their children, that can be rebuilt, that describe others, and that can be renamed.
CASCADES = (
    "table", "column", "default", "sequence", "constraint", "index", "function", "procedure", "aggregate", "domain", "type", "view",
    "materializedView", "rule", "trigger", "policy", "publication", "foreignTable",
)
REBUILDABLE = ("default", "constraint", "index", "function", "procedure", "view", "materializedView", "rule", "trigger", "eventTrigger", "policy")
METADATA = ("comment", "securityLabel", "acl")
RENAMED = (
    "role", "schema", "table", "column", "sequence", "constraint", "index", "function", "procedure", "domain", "type", "typeAttribute", "view",
    "materializedView", "trigger", "policy", "foreignTable",
)
#: Attributes without an alter form, by kind.
REPLACED = {
    "defaultPrivilege": ("privileges", "grantable"), "table": ("partitionKey", "partitionBound", "parentTable"), "column": ("collation", "generatedExpr"),
    "constraint": ("def", "type"), "index": ("def", "valid"), "function": ("returnType", "argSignature", "language", "isWindow"),
    "procedure": ("returnType", "argSignature", "language", "isWindow"),
    "aggregate": (
        "aggKind", "numDirectArgs", "sfunc", "stype", "finalfunc", "initcond", "combinefunc", "serialfunc", "deserialfunc", "msfunc", "minvfunc", "mstype", "msspace",
        "mfinalfunc", "minitcond", "finalfuncExtra", "mfinalfuncExtra", "finalfuncModify", "mfinalfuncModify", "sspace", "sortop", "parallel",
    ),
    "domain": ("baseType", "collation"), "type": ("subtype", "subtypeOpclass", "subtypeDiff", "multirangeTypeName", "collation", "variant"),
    "typeAttribute": ("collation",), "collation": ("provider", "deterministic", "locale", "lcCollate", "lcCtype"), "view": ("def",), "materializedView": ("def",),
    "rule": ("def",), "trigger": ("def",), "eventTrigger": ("event", "tags", "functionSchema", "functionName"),
    "policy": ("usingExpr", "checkExpr", "cmd", "permissive"), "publication": ("allTables",), "publicationRel": ("columns", "where"), "server": ("type", "fdw"),
    "foreignTable": ("server",), "acl": ("privileges", "grantable"),
}
#: Attributes with an alter form, by kind.
ALTERED = {
    "role": ("config", "connectionLimit", "flags", "validUntil"), "membership": ("admin",), "extension": ("schema",),
    "table": ("persistence", "rowSecurity", "forceRowSecurity", "replicaIdentity", "replicaIdentityIndex", "reloptions"), "column": ("type", "notNull", "identity"),
    "default": ("expr",), "sequence": ("dataType", "increment", "minValue", "maxValue", "start", "cache", "cycle", "ownedBy"), "constraint": ("validated",),
    "function": ("def",), "procedure": ("def",), "domain": ("default", "notNull"), "type": ("values",), "typeAttribute": ("type",), "trigger": ("enabled",),
    "eventTrigger": ("enabled",), "policy": ("roles",), "publication": ("publish", "viaRoot"),
    "subscription": ("enabled", "publications", "conninfo", "slotName", "twoPhase"), "fdw": ("options", "handler", "validator"), "server": ("version", "options"),
    "userMapping": ("options",), "foreignTable": ("options",), "comment": ("text",), "securityLabel": ("label",),
}
#: Kinds that a change of a column's type, or of a type's values, rebuilds.
REBUILDS = {("column", "type"): ("view", "materializedView", "rule", "policy", "default", "constraint", "index"), ("type", "values"): ("view", "materializedView", "default", "function", "procedure")}
#: A change to null of these is a replacement.
REPLACED_WHEN_UNSET = (("server", "version"),)
#: Kind of object that default privileges name for a kind.
DEFAULT_ACL = {
    "table": "r", "view": "r", "materializedView": "r", "foreignTable": "r", "sequence": "S", "function": "f", "procedure": "f", "aggregate": "f",
    "type": "T", "domain": "T", "schema": "n",
}
#: What PUBLIC may do on a new object of a kind.
PUBLIC_DEFAULT = {"function": "EXECUTE", "procedure": "EXECUTE", "aggregate": "EXECUTE", "type": "USAGE", "domain": "USAGE"}
#: Lock classes by kind of relation and verb.
LOCKS = {
    "table": {"create": "none", "alter": "accessExclusive", "drop": "accessExclusive"},
    "column": {"create": "accessExclusive", "alter": "accessExclusive", "drop": "accessExclusive"},
    "default": {"create": "accessExclusive", "alter": "accessExclusive", "drop": "accessExclusive"},
    "constraint": {"create": "accessExclusive", "alter": "accessExclusive", "drop": "accessExclusive"},
    "index": {"create": "share", "alter": "accessExclusive", "drop": "accessExclusive"},
    "trigger": {"create": "shareRowExclusive", "alter": "shareRowExclusive", "drop": "accessExclusive"},
    "policy": {"create": "accessExclusive", "alter": "accessExclusive", "drop": "accessExclusive"},
    "rule": {"create": "accessExclusive", "alter": "accessExclusive", "drop": "accessExclusive"},
    "view": {"create": "none", "alter": "accessExclusive", "drop": "accessExclusive"},
    "materializedView": {"create": "none", "alter": "accessExclusive", "drop": "accessExclusive"},
    "foreignTable": {"create": "none", "alter": "accessExclusive", "drop": "accessExclusive"},
    "sequence": {"create": "none", "alter": "accessExclusive", "drop": "accessExclusive"},
    "publication": {"create": "none", "alter": "shareUpdateExclusive", "drop": "none"},
}
#: Kinds whose statements lock no relation.
UNLOCKED = (
    "schema", "role", "membership", "defaultPrivilege", "extension", "function", "procedure", "aggregate", "domain", "type", "collation", "eventTrigger",
    "subscription", "fdw", "server", "userMapping", "comment", "acl",
)
#: Verbs of an action.
VERBS = ("create", "alter", "drop")


@dataclass(frozen=True)
class Rules:
    """What the planner knows of kinds and attributes; the default is the catalog's.

    ``intents``: (extension, kind of intent) with their weight; every attribute of an intent is replaced.
    """

    weights: dict[str, int] = field(default_factory=lambda: dict(WEIGHTS))
    cascades: tuple[str, ...] = CASCADES
    rebuildable: tuple[str, ...] = REBUILDABLE
    metadata: tuple[str, ...] = METADATA
    renamed: tuple[str, ...] = RENAMED
    replaced: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(REPLACED))
    altered: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(ALTERED))
    rebuilds: dict[tuple[str, str], tuple[str, ...]] = field(default_factory=lambda: dict(REBUILDS))
    unset: tuple[tuple[str, str], ...] = REPLACED_WHEN_UNSET
    destructive: tuple[str, ...] = ("table", "materializedView", "column", "typeAttribute")
    intents: dict[tuple[str, str], int] = field(default_factory=dict)

    def kinds(self, spark: SparkSession) -> DataFrame:
        """``kind, weight, cascades, rebuildable, metadata, renamed``: a row per kind."""
        rows = [(k, w, k in self.cascades, k in self.rebuildable, k in self.metadata, k in self.renamed) for k, w in sorted(self.weights.items())]
        return spark.createDataFrame(rows, "kind string, weight int, cascades boolean, rebuildable boolean, metadata boolean, renamed boolean")

    def attributes(self, spark: SparkSession) -> DataFrame:
        """``kind, attr, mode, unset, rebuilds``: a row per attribute."""
        rows = [(k, a, "replace", False, None) for k, names in sorted(self.replaced.items()) for a in names]
        rows += [(k, a, "rebuild" if (k, a) in self.rebuilds else "alter", (k, a) in self.unset, list(self.rebuilds.get((k, a), ())) or None) for k, names in sorted(self.altered.items()) for a in names]
        return spark.createDataFrame(rows, "kind string, attr string, mode string, unset boolean, rebuilds array<string>")

    def intent_weight(self, extension: Column, intent: Column) -> Column:
        """The weight that a profile declares for an intent, else the late one."""
        out = F.lit(WEIGHTS["extensionIntent"])
        for (e, i), w in sorted(self.intents.items()):
            out = F.when((extension == e) & (intent == i), F.lit(w)).otherwise(out)
        return out


def weight(kind: Column, weights: dict[str, int] = WEIGHTS) -> Column:
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, kind), F.lit(90))


def modes(sets: DataFrame, rules: Rules) -> DataFrame:
    """``sets(id, attr, from_val, to_val, kind)`` with ``mode`` (alter, replace, rebuild; null if the rules don't know the attribute) and ``rebuilds``."""
    # A few hundred rules.
    known = F.broadcast(rules.attributes(sets.sparkSession))
    mode = F.when(F.col("unset") & F.col("to_val").isNull(), "replace").when(F.col("kind") == "extensionIntent", "replace").otherwise(F.col("mode"))
    return sets.join(known, ["kind", "attr"], "left").withColumn("mode", mode).drop("unset")


def unknown_attributes(moded: DataFrame) -> DataFrame:
    """``kind, attr, n`` of the attributes that the rules don't know: a plan with any is refused."""
    return moded.where("mode is null").groupBy("kind", "attr").agg(F.count(F.lit(1)).alias("n"))


def lock_class(kind: Column, verb: Column) -> Column:
    """The lock that a statement takes; the strongest for unknown kinds."""
    table = F.create_map(*[F.lit(x) for k, verbs in LOCKS.items() for v, c in verbs.items() for x in (f"{k}|{v}", c)])
    none = F.when(kind.isin(*UNLOCKED), "none").otherwise("accessExclusive")
    return F.coalesce(F.try_element_at(table, F.concat_ws("|", kind, verb)), none)
