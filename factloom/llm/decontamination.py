"""Benchmark decontamination by winnowing, with DataFrame functions only.

A span of 13 words has six 8-grams.  Of every six neighbouring 8-grams a text
keeps those of least hash (winnowing with window w = 6 and k = 8 guarantees a
kept fingerprint in every shared span of w + k - 1 = 13 words).  Documents meet
items on kept fingerprints; each hit is extended to the 13-word windows that
contain it, which are compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import BROADCAST_ROWS, materialize, repeated, small

#: Words in a window, in a gram, and grams in a winnow.
WINDOW, GRAM = 13, 8
WINNOW = WINDOW - GRAM + 1


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, A-Z in lower case, and of all characters above U+007F."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(parts, lambda w: w != "")


def _shifted(a: str, by: int) -> Column:
    return F.slice(F.col(a), F.lit(by + 1), F.size(a))


def _paired(df: DataFrame, a: str, by: int, f) -> DataFrame:
    """Replace array ``a`` by f(a[i], a[i + by]), as many as there are."""
    left = F.slice(F.col(a), F.lit(1), F.greatest(F.size(a) - F.lit(by), F.lit(0)))
    return df.withColumn(a, F.zip_with(left, _shifted(a, by), f))


def whole_grams(n: int) -> Column:
    """A fingerprint at each place of ``_w`` where ``n`` words begin."""
    places = F.when(F.size("_w") >= n, F.sequence(F.lit(0), F.size("_w") - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.struct(i.alias("at"), i.alias("to"), F.lit(n).alias("length"), F.xxhash64(F.lit(n), F.slice("_w", i + 1, F.lit(n))).alias("fp")))


def with_fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Add ``_f``: structs ``at, length, fp`` of the kept grams of ``_w``, each once per place.

    ``length`` is the words of a window of that class: ``WINDOW``, or the
    length of an item that is shorter, whose one window is its own fingerprint
    (k = length, w = 1).
    """
    hashed = df.withColumn("_g", F.transform("_w", lambda x: F.xxhash64(x)))
    for by in (1, 2, 4):  # grams of 2, 4, 8 words
        hashed = _paired(hashed, "_g", by, lambda a, b: F.xxhash64(a, b))
    # Least of each winnow of six grams.
    hashed = hashed.withColumn("_m", F.col("_g"))
    for by in (1, 2, 2):
        hashed = _paired(hashed, "_m", by, lambda a, b: F.least(a, b))
    # Winnow i is the window of words from i; a run of winnows shares its least hash.
    changes = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1)))
    starts = F.when(F.size("_m") > 0, changes).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("_s", starts)
    found = F.zip_with(
        "_s", F.slice("_s", F.lit(2), F.size("_s")),
        lambda i, after: F.struct(i.alias("at"), (F.coalesce(after, F.size("_m")) - 1).alias("to"), F.lit(WINDOW).alias("length"), F.get("_m", i).alias("fp")),
    )
    for n in short:
        found = F.concat(found, whole_grams(n))
    return hashed.withColumn("_f", found).drop("_g", "_m", "_s")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """``window, number`` of the distinct windows, ``number, item``, ``fp`` of the kept fingerprints, and the lengths of short items."""
    own = benchmark.select(F.col(item).cast("string").alias("item"), words(F.col(text)).alias("_w")).where("item is not null and size(_w) > 0").distinct()
    n = F.size("_w")
    places = F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0)))
    spelled = own.select("item", F.explode_outer(F.transform(places, lambda i: F.array_join(F.slice("_w", i + 1, F.lit(WINDOW)), " "))).alias("window"))
    spelled = materialize(spelled.distinct(), "items")
    # Numbers are given once, when the table is written.
    windows = materialize(spelled.select("window").distinct().withColumn("number", F.monotonically_increasing_id()), "windows")
    lone = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("to"), n.alias("length"), F.xxhash64(n, F.col("_w")).alias("fp")))
    marked = with_fingerprints(own, []).withColumn("_f", F.when(n < WINDOW, lone).otherwise(F.col("_f")))
    prints = marked.select(F.explode_outer("_f.fp").alias("fp")).where("fp is not null").distinct()
    short = sorted(r[0] for r in own.select(n.alias("n")).where(F.col("n") < WINDOW).distinct().collect())  # 12 values at most
    return windows, spelled.join(windows, "window").select("number", "item"), materialize(prints, "fingerprints"), short


def met_places(documents: DataFrame, prints: DataFrame, short: list[int], broadcast: bool) -> DataFrame:
    """``id, _h, n_words, _rows, places`` of ``documents(id, _h, text)``: one row per id and text.

    ``places``: structs ``at, to, length`` of the fingerprints that items have.
    Words stay in their task; what is shuffled is a row per document and place.
    """
    named = documents.select("id", "_h", words(F.col("text")).alias("_w"))
    marked = with_fingerprints(named, short).select("id", "_h", F.size("_w").cast("long").alias("n_words"), "_f")
    # Outer generators only: the filter that others imply would be pushed through, and repeat, all the arrays above.
    if broadcast:
        # One fingerprint more per document carries its word count through the join.
        none = F.struct(F.lit(-1).alias("at"), F.lit(-1).alias("to"), F.lit(0).alias("length"), F.lit(-1).cast("long").alias("fp"))
        wanted = prints.unionByName(prints.sparkSession.sql("select -1L as fp")).distinct()
        seeds = marked.select("id", "_h", "n_words", F.explode_outer(F.concat("_f", F.array(none))).alias("f")).join(F.broadcast(wanted), F.col("f.fp") == F.col("fp"), "left_semi")
    else:
        none = F.struct(*[F.lit(x).cast(t).alias(n) for n, x, t in (("at", -1, "int"), ("to", -1, "int"), ("length", 0, "int"), ("fp", -1, "long"))])
        counted = named.select("id", "_h", F.size("_w").cast("long").alias("n_words"), none.alias("f"))
        seeds = counted.unionByName(marked.select("id", "_h", "n_words", F.explode_outer("_f").alias("f")).join(prints, F.col("f.fp") == F.col("fp"), "left_semi"))
    real = F.col("f.at") >= 0
    place = F.struct(F.col("f.at").alias("at"), F.col("f.to").alias("to"), F.col("f.length").alias("length"))
    return seeds.groupBy("id", "_h").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("f.at") == -1).alias("_rows"), F.collect_set(F.when(real, place)).alias("places"))


def window_hits(documents: DataFrame, met: DataFrame, windows: DataFrame, bound: int) -> DataFrame:
    """``id, _h, start, length, number`` of each occurrence of a window, places extended word for word.

    Only documents with a place are read again, a row each; a place's few words
    leave the row, never the document's.
    """
    hit = met.where("size(places) > 0").select(F.col("id").alias("_id"), F.col("_h").alias("_hash"), "places")
    n = hit.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    again = documents.join(small(hit, n, bound), F.col("id").eqNullSafe(F.col("_id")) & F.col("_h").eqNullSafe(F.col("_hash")))
    again = again.select("id", "_h", "places", words(F.col("text")).alias("_w"))
    near = F.transform("places", lambda p: F.struct(p["at"].alias("at"), p["length"].alias("length"), F.slice("_w", p["at"] + 1, p["to"] - p["at"] + p["length"]).alias("near")))
    runs = again.select("id", "_h", F.explode_outer(near).alias("p")).select("id", "_h", "p.at", "p.length", "p.near")
    each = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("near") - F.col("length"), F.lit(0))),
        lambda i: F.struct((F.col("at") + i).alias("start"), F.array_join(F.slice("near", i + 1, F.col("length")), " ").alias("window")),
    )
    spelled = runs.select("id", "_h", "length", F.explode_outer(each).alias("e")).select("id", "_h", "length", "e.start", "e.window")
    return spelled.join(small(windows, windows.count(), bound), "window").select("id", "_h", "start", "length", "number")


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", bound: int = BROADCAST_ROWS, text_hash: str | None = None) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` for every document.

    With ``text_hash`` a column of that name holds the text's xxhash64, which
    tells rows of one key apart.

    A window: ``WINDOW`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  A document's word inside any occurrence of a
    window is hit.  Contaminated: a twentieth of the words or more is hit.

    Null texts have no words; null item ids and items without words take no
    part; repeated items count once; repeated documents each get a row, and
    rows of one id with other texts stay apart.  With no items nothing is hit;
    without documents there are no rows.  Other columns play no part.  Memory
    grows with the longest text, in proportion.

    Fingerprints and windows of the items are broadcast if there are at most
    ``bound`` of them; beyond it they are joined by a shuffle (hot ones are
    split by the session's skew join).
    """
    windows, items, prints, short = item_windows(benchmark)
    own = documents.select(F.col(key).alias("id"), F.xxhash64(text).alias("_h"), F.col(text).alias("text"))
    met = materialize(met_places(own, prints, short, prints.count() <= bound), "places")
    hits = materialize(window_hits(own, met, windows, bound), "hits")
    # An item may hold many windows and a window be in many items: each window of a document is looked up once.
    numbers = hits.select("id", "_h", "number").distinct()
    named = numbers.join(items, "number").select("id", "_h", "item").distinct().groupBy("id", "_h").agg(F.sort_array(F.collect_list("item")).alias("_items"))
    spans = hits.groupBy("id", "_h").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_spans"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    covered = F.aggregate(
        "_spans", zero,
        lambda s, x: F.struct(
            F.greatest(s["end"], x["start"] + x["length"]).alias("end"),
            (s["total"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(x["start"], s["end"]))).alias("total"),
        ),
        lambda s: s["total"],
    )
    same = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & F.col(f"{a}._h").eqNullSafe(F.col(f"{b}._h"))
    found = spans.select("id", "_h", covered.alias("covered")).alias("s").join(named.alias("i"), same("s", "i")).select("s.id", "s._h", "covered", "_items")
    found = materialize(found.select("id", "_h", "covered", F.size("_items").alias("n"), F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items")), "found")
    both = met.select("id", "_h", "n_words", "_rows").alias("m").join(small(found, found.count(), bound).alias("f"), same("m", "f"), "left")
    out = both.select(
        F.col("m.id").alias(key), "n_words", F.coalesce("covered", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"), "_rows", *([F.col("m._h").alias(text_hash)] if text_hash else []),
    )
    return repeated(out, "_rows").withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))
