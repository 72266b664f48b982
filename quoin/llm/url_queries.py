"""Queries of the filters by address and licence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import table
from quoin.llm.license_forms import forms
from quoin.llm.licenses import inherited, scan
from quoin.llm.registry import query
from quoin.llm.urls import Rule, host_and_path, judged

# The rules, and the domains whose pages are listed.
RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"))
DOMAINS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")

_PATTERN = rf"(^|\.)({'|'.join(DOMAINS)})\.example\.(com|net|org)$"
_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rule_sql() -> str:
    out = []
    for r in sorted(RULES, key=lambda r: -len(r.text)):
        host, _, path = r.text.partition("/")
        out.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{r.text}'")
    return "CASE " + " ".join(out) + " END"


@query(
    rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, {_HOST} AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM parts
), ruled AS (SELECT *, {_rule_sql()} AS rule FROM split)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.text}' THEN '{r.verdict}'" for r in RULES)}
  WHEN regexp_matches(host, '{_PATTERN}') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
)
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page; listed are all pages (host and path) of the block-listed domains."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    host, path = host_and_path(F.col("url"))
    listed = pages.where(host.rlike(_PATTERN)).select(F.concat(host, path).alias("key"))
    return judged(pages, listed, RULES).select("page_id", "host", "path", "rule", "verdict")


# Notices of licences as they stand in files.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


@query()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence of every document, its own or its directory's.

    Documents have no paths, so one is made from their columns: a directory for each source and, within it, one
    for each 25 ids; the first file of each is its licence file, as is, for a source, the first of each 500.
    """
    part = F.floor(F.col("doc_id") / 25)
    name = F.when(F.col("doc_id") % 25 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    inner = F.concat_ws("/", "source", part.cast("string"), name)
    path = F.when(F.col("doc_id") % 500 == 0, F.concat_ws("/", "source", F.lit("LICENSE"))).otherwise(inner)
    files = table(spark, folder, "documents").select("doc_id", path.alias("path"), "text")
    return inherited(scan(files, forms(TEMPLATES))).select("doc_id", "path", "license", F.round("score", 9).alias("score"), "line", "origin")
