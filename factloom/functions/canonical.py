"""Identity and content addressing: quoted ids, canonical payloads, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that make a segment of an id quoted.
SPECIAL = r'[.:(),"\s]'


def quoted(segment: Column) -> Column:
    """A segment of an id: in double quotes, inner ones doubled, if empty or special."""
    return F.when((segment == "") | segment.rlike(SPECIAL), F.concat(F.lit('"'), F.replace(segment, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(segment)


def entity_id(kind: str | Column, *segments: Column) -> Column:
    """``kind:a.b.c`` of the quoted segments."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.concat_ws(".", *[quoted(s.cast("string")) for s in segments]))


def satellite_id(kind: str, target: Column, *more: Column) -> Column:
    """Id of a satellite, which names its target in parentheses."""
    parts = [F.concat(F.lit("."), quoted(m.cast("string"))) for m in more]
    return F.concat(F.lit(f"{kind}:("), target, F.lit(")"), *parts)


#: A segment of an id: quoted, with doubled quotes inside, or plain.
SEGMENT = r'"(?:[^"]|"")*"|[^.":(),\s]+'


def id_kind(ident: Column) -> Column:
    return F.split_part(ident, F.lit(":"), F.lit(1))


def id_segments(ident: Column) -> Column:
    """The segments of an id behind its kind, unquoted; a satellite's are those of its target."""
    body = F.regexp_replace(F.regexp_replace(ident, r"^(?:[^:(]+:\()+", ""), r"^[^:]*:", "")
    inner = F.regexp_extract_all(F.split_part(body, F.lit(")"), F.lit(1)), F.lit(SEGMENT), F.lit(0))
    return F.transform(inner, lambda s: F.when(s.startswith('"'), F.replace(F.substring(s, F.lit(2), F.length(s) - 2), F.lit('""'), F.lit('"'))).otherwise(s))


def id_schema(ident: Column) -> Column:
    """The first of several segments; null if there is one only."""
    segments = id_segments(ident)
    return F.when(F.size(segments) > 1, F.get(segments, F.lit(0)))


def id_name(ident: Column) -> Column:
    """The last segment."""
    segments = id_segments(ident)
    return F.get(segments, F.size(segments) - 1)


def id_target(ident: Column) -> Column:
    """The id in the parentheses of a satellite's; null for others."""
    found = F.regexp_extract(ident, r"^[^:(]+:\((.*)\)[^)]*$", 1)
    return F.when(found != "", found)


def clipped(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` UTF-8 bytes that cuts no character."""
    raw = text.cast("binary")
    # A continuation byte behind the cut means that the cut lies inside a character.
    ends = F.transform(F.sequence(F.lit(most), F.lit(most - 3), F.lit(-1)), lambda n: F.struct(n.alias("n"), F.hex(F.substring(raw, n + 1, F.lit(1))).alias("b")))
    whole = F.filter(ends, lambda e: (e["b"] < "80") | (e["b"] >= "C0"))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), F.get(whole, F.lit(0))["n"]).cast("string"))


def file_name(text: Column, most: int = 60) -> Column:
    """A name of at most ``most`` characters: longer ones end in part of their hash."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 9), F.lit("_"), F.substring(F.sha2(text.cast("binary"), 256), 1, 8))).otherwise(text)


def same_set(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subsequence(a: Column, b: Column) -> Column:
    """Whether ``a`` is ``b`` with some values left out."""
    step = lambda left, x: F.when((F.size(left) > 0) & (F.get(left, F.lit(0)) == x), F.slice(left, F.lit(2), F.greatest(F.size(left) - 1, F.lit(1)))).otherwise(left)
    return F.size(F.aggregate(b, a, step)) == 0


def canonical_text(value: Column) -> Column:
    """A string as JSON; plain ASCII that needs no escape is only quoted."""
    plain = value.rlike(r"\A[ !#-\[\]-~]*\z")
    return F.when(plain, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))


def canonical_number(value: Column) -> Column:
    """A decimal or integer as text; minus zero is zero; a non-finite double has no canonical form."""
    number = value.cast("double")
    odd = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(odd, F.raise_error(F.lit("non-finite number"))).when(number == 0, F.lit("0")).otherwise(value.cast("string"))


def canonical_big(value: Column) -> Column:
    """A big integer: told from a number by its suffix."""
    return F.concat(value.cast("string"), F.lit("n"))


def canonical_map(payload: Column) -> Column:
    """Canonical form of a payload of canonical values: sorted keys, those that start with ``_`` left out.

    A key without a value (null) stands for JSON null; an absent key for nothing.
    """
    entries = F.array_sort(F.map_entries(F.map_filter(payload, lambda k, v: ~k.startswith("_"))))
    pairs = F.transform(entries, lambda e: F.concat(canonical_text(e["key"]), F.lit(":"), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def content_hash(payload: Column) -> Column:
    return F.sha2(canonical_map(payload).cast("binary"), 256)


def content_hash_of(**payload: Column) -> Column:
    """What ``content_hash`` gives for a map of these entries, of plain names, without making the map."""
    pairs = [x for i, k in enumerate(sorted(k for k in payload if not k.startswith("_"))) for x in (F.lit("," * (i > 0) + f'"{k}":'), F.coalesce(payload[k], F.lit("null")))]
    return F.sha2(F.concat(F.lit("{"), *pairs, F.lit("}")).cast("binary"), 256)


def _words(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)]


def _counted(n: Column, sums: list[Column]) -> Column:
    return F.sha2(F.concat_ws("|", n.cast("string"), *[w.cast("string") for w in sums]).cast("binary"), 256)


def multiset_hash(digest: Column) -> Column:
    """Aggregate: a hash of a multiset of SHA-256 digests (hex), whatever their order.

    Adds up the first four 32-bit words of the digests; count and sums are hashed.
    Tasks add up their own rows, and the state has a fixed size.
    """
    return _counted(F.count(digest), [F.sum(w) for w in _words(digest)])


def multiset_hash_of(*digests: Column) -> Column:
    """What ``multiset_hash`` gives for the digests of one row."""
    return _counted(F.lit(len(digests)), [sum(ws[1:], ws[0]) for ws in zip(*map(_words, digests), strict=True)])
