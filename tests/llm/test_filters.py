"""URL filters against their SQL and plain sets, licence scans against a plain version, the pipeline stage by stage."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalog.compare import oracle_connection
from quoin.llm import urls
from quoin.llm.licenses import inherited, scan
from quoin.llm.registry import ORACLES
from quoin.llm.url_queries import RULES, TEMPLATES, op3_license_scan, op4_url_filter
from tests.llm.cases import letters

FOLDER = "/root/testdata/sf0.001"


def test_url_query_equals_its_sql(spark):
    want = oracle_connection(FOLDER).execute(ORACLES["op4_url_filter"]).fetchall()
    got = [tuple(r) for r in op4_url_filter(spark, FOLDER).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(got) > 10


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match("[^?#]*", rest[len(host) :])[0]


@pytest.mark.parametrize("words", [1 << 21, 0])
def test_verdicts_on_awkward_urls(spark, monkeypatch, words):
    monkeypatch.setattr(urls, "WORDS", words)  # 0: every list is too long and joined
    given = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x?q", "http://notexample.org/es/", "a://b://c/d", "http://x.com/fr/../de/", "http://x.com/de/é#f", "http://com", "x://org?y", "http://ÄB.net/a\nb"]
    given += [f"http://h{k % 50}.net/p{k}" for k in range(3000)] + ["http://h1.net/p1"]
    listed = {f"h{k % 50}.net/p{k}" for k in range(0, 3000, 3)} | {"absent.net/"}
    pages = spark.createDataFrame([(u, "old") for u in given], "url string, host string")
    keys = spark.createDataFrame([(k,) for k in [*listed, None, "h0.net/p0"]], "key string")
    for r in urls.judged(pages, keys, RULES).collect():
        host, path = plain(r["url"])
        fits = [x for x in RULES if (host == x.text.split("/")[0] or host.endswith("." + x.text.split("/")[0])) and path.startswith("/" + x.text.partition("/")[2])]
        rule = max(fits, key=lambda x: len(x.text)) if fits else None
        verdict = rule.verdict if rule else "block" if host + path in listed else "allow"
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule and rule.text, verdict)
    assert urls.judged(pages.limit(0), keys, RULES).count() == 0
    assert urls.judged(pages, keys.limit(0), RULES).where("rule is null and verdict = 'block'").count() == 0


def test_cascade_levels_shrink_and_answer_exactly(spark):
    universe = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    filters = urls.cascade(universe)
    assert len(filters.bits) >= 3 and filters.bits[2] < filters.bits[0]
    assert universe.where(filters.listed(F.col("key")) != F.col("listed")).count() == 0


def best_line(text, whole, idf, most):
    """(score, -line, name) of the best passage, by dictionaries."""
    found = []
    passages = list(enumerate((text or "").split("\n"), 1)) + ([(0, text or "")] if whole else [])
    for line, passage in passages:
        mine = Counter(letters(passage))
        if not mine:
            continue
        norm = math.sqrt(sum((n * idf[w]) ** 2 if w in idf else n * most * most for w, n in mine.items()))
        for name, template in TEMPLATES.items():
            other = Counter(letters(template))
            size = math.sqrt(sum((n * idf[w]) ** 2 for w, n in other.items()))
            found.append((sum(n * idf[w] * other[w] * idf[w] for w, n in mine.items() if w in other) / (norm * size), name, line))
    return max((x[0] for x in found), default=0.0), found


def test_scan_equals_plain_cosines(spark):
    texts = {
        "a/LICENSE": "Some words before\nLicensed under the Apache License, Version 2.0.\n",
        "a/x.py": "# Released under the MIT License.\nimport this\n",
        "a/b/y.py": "the of version 2 and the rest of a prose line under no licence",
        "COPYING.txt": "This work is licensed under the GNU General\nPublic License, version 3.",
        "n/null": None, "n/empty": "", "n/blank": " \n\n ", "n/odd": "License",
    }
    files = spark.createDataFrame([(p, t, "clash") for p, t in texts.items()] + [(None, "Released under the MIT License.", "clash")], "path string, text string, score string")
    n = len(texts) + 1
    everything = [*texts.values(), "Released under the MIT License."]
    frequency = Counter(w for t in everything for w in set(letters(t)))
    idf = {w: math.log((1 + n) / (1 + frequency[w])) + 1e-9 for t in TEMPLATES.values() for w in letters(t)}
    for r in scan(files, TEMPLATES).collect():
        text = texts.get(r["path"], "Released under the MIT License.")
        score, _ = best_line(text, bool(re.match("(?i)(license|copying)", (r["path"] or "").split("/")[-1])), idf, math.log(1 + n))
        assert math.isclose(r["score"], score, abs_tol=1e-9)
    by = {r["path"]: r for r in inherited(scan(files, TEMPLATES)).collect()}
    assert by["a/LICENSE"]["license"] == "Apache-2.0" and by["a/LICENSE"]["line"] == 2
    assert by["a/x.py"]["license"] == "MIT" and by["a/x.py"]["origin"] == "a/x.py"
    assert (by["a/b/y.py"]["license"], by["a/b/y.py"]["origin"]) == ("Apache-2.0", "a/LICENSE")
    assert (by["COPYING.txt"]["license"], by["COPYING.txt"]["line"]) == ("GPL-3.0", 0)
    assert (by["n/null"]["license"], by["n/null"]["origin"]) == ("GPL-3.0", "COPYING.txt")
    assert by[None]["license"] == "MIT"
    assert inherited(scan(files.limit(0), TEMPLATES)).count() == 0


def test_licences_of_given_documents(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = op3_license_scan(spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows:
        own = {name for name, notice in TEMPLATES.items() if notice in texts[r["doc_id"]].split("\n")}
        if own or r["origin"] == r["path"]:
            assert r["license"] in own and r["origin"] == r["path"]
