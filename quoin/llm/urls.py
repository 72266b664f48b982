"""URL filters: rules on hosts and paths, and exact list membership by a cascade of Bloom filters.

Level 0 of the cascade encodes the listed keys.  Level 1 encodes the keys of the corpus that level 0 takes for
listed ones, level 2 the listed keys that level 1 takes for those, and so on until nothing is mistaken.  The
first level that doesn't hold a key decides, so every key of the corpus gets its exact answer without a join.
All steps are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.session import durable

#: Bits per key and bits set per key of each level.
BITS, HASHES = 10, 5
#: Most 64-bit words of a level that tasks may hold; a longer list is joined instead.
WORDS = 1 << 21

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


@dataclass(frozen=True)
class Rule:
    """``host/path`` and what it says; fits the host and its subdomains where the path begins with the rule's."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


def longest_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Text of the longest rule that fits, or null; of equally long ones the first in alphabetical order."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        out = F.when(rule.fits(host, path), rule.text).otherwise(out)
    return out


def _places(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * HASHES + k), key), F.lit(bits).cast("bigint")) for k in range(HASHES)]


@dataclass
class Cascade:
    """Stored levels: (``level``, ``words``), and the number of bits of each."""

    levels: DataFrame
    bits: list[int]

    def holds(self, key: Column, level: int) -> Column:
        """Whether a level takes the key for one of its own."""
        words = self.levels.where(F.col("level") == level).select("words").scalar()
        out = F.lit(True)
        for place in _places(key, level, self.bits[level]):
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            out = out & (F.getbit(word, F.pmod(place, F.lit(64)).cast("int")) == 1)
        return out

    def listed(self, key: Column) -> Column:
        """Whether a key of the corpus is listed; null is not."""
        out = F.lit(len(self.bits) % 2 == 1)
        for level in reversed(range(len(self.bits))):
            out = F.when(~self.holds(key, level), F.lit(level % 2 == 1)).otherwise(out)
        return F.coalesce(out & key.isNotNull(), F.lit(False))


def _level(keys: DataFrame, level: int, bits: int) -> DataFrame:
    place = F.explode(F.array(*_places(F.col("key"), level, bits))).alias("place")
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("place", F.lit(64)).cast("int"))).alias("bits"))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word").join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0)).alias("bits"))
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words")).select(F.lit(level).alias("level"), "words")


def cascade(universe: DataFrame) -> Cascade | None:
    """The cascade for all keys of a corpus (distinct ``key`` with ``listed``); none if a level would be too large."""
    keys = durable(universe.where("key is not null").select("key", "listed"))
    levels, bits, members, others, level = None, [], keys.where("listed"), keys.where("not listed"), 0
    while True:
        n = members.count()
        if n == 0:
            break
        size = -(-n * BITS // 64) * 64
        if size // 64 > WORDS:
            return None
        own = durable(_level(members, level, size))
        bits.append(size)
        levels = own if levels is None else levels.union(own)
        held = Cascade(levels, bits).holds(F.col("key"), level)
        members, others, level = durable(others.where(held)), members, level + 1
    if levels is None:
        levels = keys.sparkSession.createDataFrame([], "level int, words array<bigint>")
    return Cascade(levels, bits)


def judged(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the rule's, else whether host and path are listed.

    ``listed`` holds the listed keys (``key``: host and path in one).  Null urls and those without ``://`` have
    empty host and path and the key "".  Repeated rows and keys do no harm; an empty list blocks nothing.  Columns
    named like the new ones are replaced.
    """
    host, path = host_and_path(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    rows = rows.withColumn("rule", longest_rule(rules, F.col("host"), F.col("path")))
    of_rule = F.lit(None).cast("string")
    for r in rules:
        of_rule = F.when(F.col("rule") == r.text, r.verdict).otherwise(of_rule)
    key = F.concat("host", "path")
    own = listed.select("key").where("key is not null").distinct()
    universe = rows.select(key.alias("key")).distinct().join(own.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    filters = cascade(universe)
    if filters is None:  # too long for tasks to hold: the same answer by a join
        marked = rows.withColumn("_url_key", key).join(own.select(F.col("key").alias("_url_key"), F.lit(True).alias("_listed")), "_url_key", "left")
        verdict = F.when(F.col("_listed"), "block").otherwise("allow")
        return marked.withColumn("verdict", F.coalesce(of_rule, verdict)).drop("_url_key", "_listed")
    return rows.withColumn("verdict", F.coalesce(of_rule, F.when(filters.listed(key), "block").otherwise("allow")))
