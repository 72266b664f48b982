"""SimHash fingerprints and a search among them, in DataFrame functions only.

Terms are pairs of neighbouring words (and the last word).  The 64-bit hash of each term votes on every bit with
the term's weight, the length of its words.  Two bits share a sum, one in each half of a 64-bit number, so a text
needs 32 sums.  The search cuts fingerprints into blocks: within a radius r, of 2 r blocks at least r are equal, so
there is one table for each choice of r blocks, keyed by them.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text of each stretch of the document order.
STRETCH = 1 << 21
#: Most stretches; beyond, they grow instead.
STRETCHES = 4096
#: Longest words count no more than this.
WEIGHT = 12

_GAP = "[\\x20\\x09-\\x0D]+"
_LEAST = -(1 << 63)


def terms(text: Column) -> Column:
    """Array of (``hash``, ``weight``) of a text's terms."""
    words = F.filter(F.split(F.lower(text), _GAP), lambda w: w != "")
    size = lambda w: F.least(F.coalesce(F.char_length(w), F.lit(0)), F.lit(WEIGHT))
    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.struct(F.xxhash64(a, b).alias("hash"), (size(a) + size(b)).cast("bigint").alias("weight")))


def _shifted(value: Column, by: int) -> Column:
    return F.call_function("shiftleft", value, F.lit(by))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` with ``fp`` (bigint): the fingerprint of ``text``; 0 without words, so empty and null texts agree.

    Rows of equal keys are taken as parts of one text.
    """
    votes = texts.select(*keys, F.inline_outer(terms(F.col(text))))
    low = F.lit((1 << 32) + 1)
    lanes = [F.sum(F.shiftrightunsigned("hash", k).bitwiseAND(low) * F.col("weight")).alias(f"_v{k}") for k in range(32)]
    sums = votes.groupBy(*keys).agg(F.sum("weight").alias("_all"), *lanes)
    half = lambda k, high: F.shiftrightunsigned(f"_v{k}", 32) if high else F.col(f"_v{k}").bitwiseAND(F.lit((1 << 32) - 1))
    bit = lambda k, high: F.when(2 * half(k, high) > F.col("_all"), _shifted(F.lit(1).cast("bigint"), k + 32 * high)).otherwise(F.lit(0).cast("bigint"))
    # In steps, so that no expression outgrows what the JVM compiles.
    words = sums.select(*keys, *(reduce(lambda a, b: a.bitwiseOR(b), [bit(k, high) for k in range(begin, begin + 8)]).alias(f"_w{begin + 32 * high}") for high in (False, True) for begin in range(0, 32, 8)))
    return words.select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"_w{k}") for k in range(0, 64, 8)]).alias("fp"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents in stretches of the order of ``key`` (nulls first) and text, each with the next text.

    Columns: ``stretch``, ``place`` (0: a document; 1, 2: a copy of the row that follows the stretch, which is
    there so that the last document finds it), ``id``, ``text`` (null: empty) and ``next_text``.
    The row after the last is the first.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = F.coalesce("id", F.lit(_LEAST).cast("bigint"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(STRETCHES, int(size // STRETCH) + 1)
    found = rows.select(order.alias("o")).agg(F.percentile_approx("o", F.array(*(F.lit(k / n) for k in range(1, n))), 20 * n).alias("b") if n > 1 else F.lit(None).alias("b"), F.min("o").alias("least")).first()
    least = found["least"] if found["least"] is not None else 0
    bounds = sorted({b for b in found["b"] or [] if b > least})
    edges = F.array(*map(F.lit, bounds)).cast("array<bigint>")
    stretch = F.size(F.filter(edges, lambda b: b <= F.col("o")))
    own = F.struct(F.col("stretch"), F.lit(0).alias("place"))
    before = F.when(F.array_contains(edges, F.col("o")), F.struct((F.col("stretch") - 1).alias("stretch"), F.lit(1).alias("place")))
    around = F.when(F.col("o") == least, F.struct(F.lit(len(bounds)).alias("stretch"), F.lit(2).alias("place")))
    places = F.filter(F.array(own, before, around), lambda x: x.isNotNull())
    placed = rows.withColumn("o", order).withColumn("stretch", stretch).select("id", "text", "o", F.inline(places))
    window = Window.partitionBy("stretch").orderBy("place", "o", "text")
    return placed.withColumn("next_text", F.lead("text").over(window)).select("stretch", "place", "o", "id", "text", "next_text")


def compared(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_chars``, ``edited_sha256``, ``fp``, ``edited_fp``, ``next_fp``.

    The edited text has its last floor(n / 2) characters replaced by the first as many (or all) of the next
    document.  Null texts are empty; of equal ids the row with the smaller text comes first, null ids come before
    all others; a single document follows itself.  Other columns don't matter.
    """
    rows = with_next(docs, key, text)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    keys = ["row", "stretch", "place", "o", "id", "n_chars", "edited_sha256"]
    both = rows.select(
        F.monotonically_increasing_id().alias("row"), "stretch", "place", "o", "id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited")
    ).withColumns({"edited_sha256": F.sha2("edited", 256)})
    each = both.select(*keys, F.explode(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("text")))).alias("x"))
    fps = fingerprints(each.select(*keys, "x.is_edited", "x.text"), [*keys, "is_edited"])
    one = fps.groupBy(*keys).agg(F.max(F.when(~F.col("is_edited"), F.col("fp"))).alias("fp"), F.max(F.when(F.col("is_edited"), F.col("fp"))).alias("edited_fp"))
    window = Window.partitionBy("stretch").orderBy("row")
    return one.withColumn("next_fp", F.lead("fp").over(window)).where("place = 0").select(F.col("id").alias(key), "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


def _tables(fp: Column, radius: int) -> Column:
    """A key for each table."""
    if radius == 0:
        return F.array(fp)
    cuts = [64 * k // (2 * radius) for k in range(2 * radius + 1)]
    masks = [((1 << cuts[k + 1]) - (1 << cuts[k])) for k in range(2 * radius)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed(reduce(or_, some))).cast("bigint"))) for k, some in enumerate(combinations(masks, radius))))


def within(queries: DataFrame, all_fps: DataFrame, radius: int) -> DataFrame:
    """Distinct pairs (``fp``, ``other``, ``distance``) of a query's fingerprint and one in ``all_fps`` at most ``radius`` bits away.

    Both tables have ``fp``; equal and null fingerprints are taken once, so copies cost nothing.  A fingerprint
    finds itself.
    """
    tables = lambda df, name: df.select("fp").where("fp is not null").distinct().select(F.col("fp").alias(name), F.explode(_tables(F.col("fp"), radius)).alias("entry"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    return tables(queries, "fp").join(tables(all_fps, "other"), "entry").where(distance <= radius).select("fp", "other", distance.cast("int").alias("distance")).distinct()
