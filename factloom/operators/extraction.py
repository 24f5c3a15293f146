"""Shapes of extraction: grants, memberships, resolvers, samples, redaction, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import multiset_hash
from factloom.storage import materialize


def sorted_set(column: str | Column, where: Column | None = None) -> Column:
    """Distinct values in order, joined by commas; empty if none."""
    value = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.sort_array(F.collect_set(value if where is None else F.when(where, value))), ",")


def grants(rows: DataFrame) -> DataFrame:
    """``object, grantee, privileges, grantable`` of ``rows(object, grantee, privilege, grantable)``."""
    return rows.groupBy("object", "grantee").agg(sorted_set("privilege").alias("privileges"), sorted_set("privilege", F.col("grantable")).alias("grantable"))


def grants_against(now: DataFrame, before: DataFrame) -> DataFrame:
    """Grantees whose privileges differ from ``before``; null on the side that lacks them."""
    old = before.select("object", "grantee", F.col("privileges").alias("before"))
    both = now.select("object", "grantee", F.col("privileges").alias("now")).join(old, ["object", "grantee"], "full")
    return both.where(~F.col("now").eqNullSafe(F.col("before")))


def deviations(explicit: DataFrame, builtin: DataFrame) -> DataFrame:
    """Explicit grants that are not the built-in ones, and built-in ones that were revoked (empty privileges)."""
    keyed = explicit.join(builtin.select("object", "grantee", F.col("privileges").alias("b")), ["object", "grantee"], "left")
    other = keyed.where(~F.col("privileges").eqNullSafe(F.col("b"))).select("object", "grantee", "privileges")
    touched = builtin.join(explicit.select("object").distinct(), "object", "left_semi")
    revoked = touched.join(explicit.select("object", "grantee"), ["object", "grantee"], "left_anti").select("object", "grantee", F.lit("").alias("privileges"))
    return other.unionByName(revoked)


def with_revoked(own: DataFrame, objects: DataFrame, public: str = "PUBLIC") -> DataFrame:
    """Grants, and an empty row for PUBLIC and the owner of ``objects(object, owner)`` where a default was revoked."""
    expected = objects.select("object", F.explode(F.array_distinct(F.array(F.lit(public), F.col("owner")))).alias("grantee"))
    lost = expected.join(own.select("object", "grantee"), ["object", "grantee"], "left_anti")
    return own.unionByName(lost.select("object", "grantee", F.lit("").alias("privileges"), F.lit("").alias("grantable")))


def grants_of_members(now: DataFrame, installed: DataFrame, members: DataFrame) -> DataFrame:
    """``object, grantee, privileges``: of extension members what differs from the installed grants, of others all."""
    differ = grants_against(now, installed).select("object", "grantee", F.coalesce("now", F.lit("")).alias("privileges"))
    return differ.join(members, "object", "left_semi").unionByName(now.select("object", "grantee", "privileges").join(members, "object", "left_anti"))


def memberships(rows: DataFrame, roles: DataFrame, members: DataFrame) -> DataFrame:
    """``role, member, admin``: one row for all grantors of ``rows(role, member, admin)``; names by ``(oid, name)``."""
    once = rows.groupBy("role", "member").agg(F.bool_or("admin").alias("admin"))
    named = once.join(roles.select(F.col("oid").alias("role"), F.col("name").alias("r")), "role").join(members.select(F.col("oid").alias("member"), F.col("name").alias("m")), "member")
    return named.select(F.col("r").alias("role"), F.col("m").alias("member"), "admin")


def samples(rows: DataFrame, by: str, value: str, n: int = 5) -> DataFrame:
    """Count and the first ``n`` values of each group: a rank cuts the rows, no group is collected."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(value))
    first = rows.select(by, value).withColumn("_r", rank).where(F.col("_r") <= n).groupBy(by).agg(F.array_join(F.sort_array(F.collect_list(value)), ",").alias("samples"))
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).join(first, by)


def probes(kinds: dict[str, DataFrame], n: int = 5) -> DataFrame:
    """``kind, n, samples`` of each kind's ids."""
    rows = None
    for kind, ids in kinds.items():
        own = ids.select(F.lit(kind).alias("kind"), F.col("id").cast("long").alias("id"))
        rows = own if rows is None else rows.unionByName(own)
    return samples(rows, "kind", "id", n)


def unmodeled_drift(shadow: DataFrame, target: DataFrame, key: str, kind: str) -> DataFrame:
    """``kind, n``: what the shadow has and the target lacks."""
    return shadow.join(target.select(key), key, "left_anti").groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def with_presence(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``present``: whether ``other`` has the key, in one join."""
    known = other.select(key).distinct().withColumn("present", F.lit(True))
    return rows.join(known, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def ordered_arguments(rows: DataFrame, by: str, parts: list[str], first: str) -> DataFrame:
    """``by, args, first_parent``: a group's parts in order, and one column of its first row."""
    one = F.struct(*parts)
    text = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.concat_ws(":", *[x[p].cast("string") for p in parts]))
    return rows.groupBy(by).agg(F.array_join(text, ",").alias("args"), F.min_by(first, one).alias("first_parent"))


def known_ids(resolvers: list[DataFrame]) -> DataFrame:
    """``class, obj, id`` by the first resolver ``(class, obj, id)`` that knows an object."""
    known = None
    for priority, resolver in enumerate(resolvers):
        own = resolver.select("class", "obj", "id", F.lit(priority).alias("priority"))
        known = own if known is None else known.unionByName(own)
    return known.groupBy("class", "obj").agg(F.min(F.struct("priority", "id")).alias("best")).select("class", "obj", F.col("best.id").alias("id"))


def resolve(endpoints: DataFrame, resolvers: list[DataFrame]) -> DataFrame:
    """``class, obj, id``: each endpoint by the first resolver that knows it; null if none."""
    return endpoints.select("class", "obj").distinct().join(known_ids(resolvers), ["class", "obj"], "left")


def resolved_edges(rows: DataFrame, resolvers: list[DataFrame]) -> DataFrame:
    """``from_id, to_id`` of ``rows(class, obj, ref_class, ref_obj)``, each once, where both ends are known."""
    known = materialize(known_ids(resolvers), "resolved")
    once = rows.select("class", "obj", "ref_class", "ref_obj").distinct()
    named = once.join(known.withColumnRenamed("id", "from_id"), ["class", "obj"])
    return named.join(known.select(F.col("class").alias("ref_class"), F.col("obj").alias("ref_obj"), F.col("id").alias("to_id")), ["ref_class", "ref_obj"]).select("from_id", "to_id").distinct()


def cleaned_edges(rows: DataFrame, system: Column, shadowed: DataFrame) -> DataFrame:
    """``from_id, to_id``, each once, without ``system`` rows, edges to oneself and those of ``shadowed(from_id, to_id)``."""
    own = rows.where(~F.coalesce(system, F.lit(False)) & (F.col("from_id") != F.col("to_id"))).select("from_id", "to_id").distinct()
    return own.join(shadowed.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")


def redact(url: Column, allowed: list[str]) -> Column:
    """Values of query parameters that are not ``allowed`` become a placeholder."""
    query = F.split(F.split_part(url, F.lit("?"), F.lit(2)), "&")
    one = lambda p: F.when(F.split_part(p, F.lit("="), F.lit(1)).isin(allowed) | ~F.contains(p, F.lit("=")), p).otherwise(F.concat(F.split_part(p, F.lit("="), F.lit(1)), F.lit("=***")))
    return F.when(F.contains(url, F.lit("?")), F.concat(F.split_part(url, F.lit("?"), F.lit(1)), F.lit("?"), F.array_join(F.transform(query, one), "&"))).otherwise(url)


#: Options of foreign objects that may be shown.
SHOWN = ("host", "port", "dbname", "schema_name", "table_name", "user", "use_remote_estimate", "fetch_size", "updatable")


def redacted_options(options: Column, shown: tuple[str, ...] = SHOWN) -> Column:
    """Options ``key=value`` in order; values of keys that are not shown become a placeholder."""
    one = lambda o: F.when(F.lower(F.split_part(o, F.lit("="), F.lit(1))).isin(*shown), o).otherwise(F.concat(F.split_part(o, F.lit("="), F.lit(1)), F.lit("=__REDACTED__")))
    return F.array_sort(F.transform(options, one))


def redacted_conninfo(text: Column) -> Column:
    """A connection string whose password and key material is a placeholder; quoted values whole."""
    return F.regexp_replace(text, r"(?i)\b(password|passfile|sslpassword|sslkey)\s*=\s*('(?:[^'\\\\]|\\\\.)*'|\S+)", "$1=__REDACTED__")


def fingerprint(rows: DataFrame, by: str) -> DataFrame:
    """``by, rows, content``: order-independent content hash of the other columns.

    Hashes of rows are added up by each task, so a group of any size is one small row.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in rows.columns if c != by])
    hashed = rows.select(by, F.sha2(text.cast("binary"), 256).alias("h"))
    return hashed.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), multiset_hash(F.col("h")).alias("content"))


def row_text(rows: DataFrame) -> Column:
    """All columns of a row as JSON, by name: doubles as decimals where that is exact, times to the microsecond."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            exact = c.try_cast("decimal(38,6)")
            return F.when(exact.cast("double") == c.cast("double"), exact.cast("string")).otherwise(c.cast("string"))
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if kind in ("timestamp", "timestamp_ntz") else c

    return F.to_json(F.struct(*[one(n, k).alias(n) for n, k in sorted(rows.dtypes)]), {"ignoreNullFields": "false"})


def statistics(rows: DataFrame, key: Column) -> DataFrame:
    """``key, rows, signature, content`` of each ``key``: count, columns with their types, fingerprint of whole rows."""
    signature = ",".join(f"{n}:{k}" for n, k in sorted(rows.dtypes))
    return fingerprint(rows.select(key.alias("key"), row_text(rows).alias("row")), "key").select("key", "rows", F.lit(signature).alias("signature"), "content")


def load_rounds(files: DataFrame, requires: DataFrame) -> DataFrame:
    """``id, round``: a file loads once all it requires is loaded; what never loads has a null round.

    Requirements are counted down: a round joins them with what has just loaded.
    """
    needs = materialize(requires.select("id", "needs").distinct(), "needs")
    waiting = materialize(files.select("id").distinct().join(needs.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "waiting")
    done = []
    while True:
        ready = materialize(waiting.where("n = 0").select("id", F.lit(len(done)).cast("int").alias("round")), "ready")
        if not ready.take(1):
            break
        done.append(ready)
        met = needs.join(ready.select(F.col("id").alias("needs")), "needs", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("met"))
        waiting = materialize(waiting.where("n > 0").join(met, "id", "left").select("id", (F.col("n") - F.coalesce("met", F.lit(0))).alias("n")), "waiting")
    stuck = waiting.where("n > 0").select("id", F.lit(None).cast("int").alias("round"))
    for ready in done:
        stuck = stuck.unionByName(ready)
    return stuck
