"""License scans: TF-IDF cosine of passages to templates, and inheritance along directories.

A passage is a line of a file, its header (the leading block of comment lines, or else the first paragraph), the
whole text where the file is a licence file by its name, and every group of neighbouring lines and sentences that
begins at one of them and is about as long as a template.  Only words of the templates have a weight of their own,
with document frequencies counted over all files; every other word counts as one that occurs in no file, the
largest weight there is, so a line of prose that shares words with a template stays far from it.  A file without a
licence of its own takes that of the nearest directory above it that holds a licence file.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quoin.llm.common import carried, flat, slices
from quoin.llm.words import LETTERS, words
from quoin.session import durable

#: Names of licence files, whatever their case and ending.
NAMES = ("license", "licence", "copying", "unlicense")
_NAME = rf"(?i)^({'|'.join(NAMES)})(\.[^.]*)?$"
#: Templates of fewer words are titles.
TITLE = 5
#: Words of groups that are worked out at a time; bounds memory.
WORK = 1 << 19
_STOP, _SPACE, _MARK = (np.isin(np.arange(256), list(c)) for c in (b".!?:;", b" \t\n\v\f\r", b"#/*;-%!<'\""))


def _terms(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes of all templates, and how often each template (row) has each."""
    found = [words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), LETTERS).hashes for t in texts]
    vocabulary = np.unique(np.concatenate(found))
    counts = np.zeros((len(texts), len(vocabulary)))
    for row, hashes in zip(counts, found, strict=True):
        np.add.at(row, np.searchsorted(vocabulary, hashes), 1)
    return vocabulary, counts


def _lookup(vocabulary: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in the vocabulary, -1 if it has none."""
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1)


def _frequencies(rows: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(``term``, ``files``): files that hold each term of the vocabulary."""
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("files", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches, "_text"):
            found = words(*flat(batch.column("_text")), LETTERS)
            term = _lookup(vocabulary, found.hashes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.firsts))
            pairs = np.unique(row[term >= 0] * len(vocabulary) + term[term >= 0])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=schema.fieldNames())

    return rows.select("_text").mapInArrow(run, schema).groupBy("term").agg(F.sum("files").alias("files"))


def _weights(group: np.ndarray, groups: int, term: np.ndarray, idf: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct known words of each group of words (group, term, weight), and the norm of each group."""
    known = term >= 0
    pairs, n = np.unique(group[known] * len(idf) + term[known], return_counts=True)
    owner, term = pairs // len(idf), pairs % len(idf)
    weight = n * idf[term]
    norm = np.bincount(owner, weight * weight, groups) + np.bincount(group[~known], minlength=groups) * most * most
    return owner, term, weight, np.sqrt(np.maximum(norm, 1e-300))


class _Templates:
    """Unit vectors of all forms of all licences; the forms of a licence share its ``label``."""

    def __init__(self, label: np.ndarray, counts: np.ndarray, idf: np.ndarray, most: float, threshold: float):
        self.label, self.idf, self.most, self.threshold = label, idf, most, threshold
        self.unit = counts * idf
        self.unit /= np.linalg.norm(self.unit, axis=1, keepdims=True)
        self.length = counts.sum(1).astype(np.int64)
        self.distinct = (counts > 0).sum(1)

    def key(self, t: int, cosine: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What decides among passages (of ``size`` words) and templates: the cosine; from the threshold on first the words
        that match, by steps (titles and notices, headers, texts; a text names other licences), and last the length."""
        step = np.maximum(0, np.floor(np.log2(np.maximum(np.minimum(size, self.length[t]), 1) / 8) / 2))
        return np.where(cosine >= self.threshold, 2 * (step + 1) + 1e-7 * min(self.length[t], 32), 0.0) + cosine

    def cosine(self, t: int, groups: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Cosine of each group to a template; 0 where a title lacks one of its words."""
        own = self.unit[t][term]
        cosine = np.bincount(owner, weight * own, groups) / norm
        return np.where(np.bincount(owner, own > 0, groups) < self.distinct[t], 0.0, cosine) if self.length[t] < TITLE else cosine

    def best(self, group: np.ndarray, groups: int, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, label and cosine of the best template for each group of words."""
        some, size = _weights(group, groups, term, self.idf, self.most), np.bincount(group, minlength=groups)
        key, label, score = np.full(groups, -1.0), np.zeros(groups, np.int64), np.zeros(groups)
        for t in range(len(self.label)):
            cosine = self.cosine(t, groups, *some)
            mine = self.key(t, cosine, size)
            better = mine > key + 1e-12
            key[better], label[better], score[better] = mine[better], self.label[t], cosine[better]
        return key, label, score


class _Found:
    """The best passage of each row so far."""

    def __init__(self, rows: int):
        self.key, self.label, self.score, self.place = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows), np.zeros(rows, np.int64)

    def offer(self, row: np.ndarray, key: np.ndarray, label: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        order = np.lexsort((place, label, -np.round(key, 12), row))
        first = order[np.unique(row[order], return_index=True)[1]]
        row, key, label, score, place = row[first], key[first], label[first], score[first], place[first]
        gap = np.round(key, 12) - np.round(self.key[row], 12)
        tie = (gap == 0) & (self.key[row] > 0)
        now = (gap > 0) | (tie & ((label < self.label[row]) | ((label == self.label[row]) & (place < self.place[row]))))
        at = row[now]
        self.key[at], self.label[at], self.score[at], self.place[at] = key[now], label[now], score[now], place[now]


def _cuts(data: np.ndarray) -> np.ndarray:
    """Where lines and sentences end."""
    stop = _STOP[data]
    stop[:-1] &= _SPACE[data[1:]]
    return np.flatnonzero(stop | (data == 10))


def _header_words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, starts: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Words of the header of their row: its leading comment lines or, without a comment, its first paragraph."""
    begins = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], ends + 1]))
    begins = begins[begins < len(data)]
    printed = np.append(np.flatnonzero(~_SPACE[data]), len(data))
    first = printed[np.searchsorted(printed, begins)]
    filled = first < np.append(begins[1:], len(data))
    mark = filled & _MARK[np.append(data, 0)[first]]
    owner = np.searchsorted(offsets, begins, "right") - 1
    rows = len(offsets) - 1
    lines = np.arange(len(begins))
    opening = np.full(rows, len(begins))
    np.minimum.at(opening, owner[filled], lines[filled])  # its first line with text
    comment = np.append(mark, False)[opening]
    over = np.append(lines[~np.where(comment[owner], mark, filled) & (lines >= opening[owner])], len(begins))
    last = over[np.searchsorted(over, opening)]
    return starts < np.append(begins, len(data))[last][row]


def scan(files: DataFrame, templates: Mapping[str, str | Sequence[str]], threshold: float = 0.75, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` without ``text``, with ``license`` (null if none), ``score`` and ``line``.

    A licence has one template or several.  ``score`` is the best cosine of any passage (0 without words), ``line``
    the first line, from 1, of the passage that has it (0: the whole text), and ``license`` the licence of its
    template where the score reaches the threshold.  Of several passages that reach it, those that match longer
    templates come first (by steps of four from 32 words on), since full texts name other licences.  A title of less
    than five words counts only with all its words.  Ties go to the longer template, then to the first name in
    alphabetical order.  Null and empty texts have no licence; null paths are no licence files.  Columns named like
    the new ones are replaced.
    """
    names = sorted(templates)
    pairs = [(k, t) for k, n in enumerate(names) for t in ((templates[n],) if isinstance(templates[n], str) else templates[n])]
    vocabulary, counts = _terms([t for _, t in pairs])
    new = [T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("line", T.LongType())]
    kept = [c for c in files.columns if c not in (text, "license", "score", "line")]
    named = F.element_at(F.split(F.col(f"`{path}`"), "/"), -1).rlike(_NAME)
    rows = files.select(carried(files, text), F.col(f"`{text}`").cast("string").alias("_text"), F.coalesce(named, F.lit(False)).alias("_whole"))
    schema = T.StructType([rows.schema["given"], *new])
    n_files = files.count()
    frequency = np.zeros(len(vocabulary))
    for row in _frequencies(rows, vocabulary).collect():  # one row per word of the templates
        frequency[row["term"]] = row["files"]
    most = float(np.log(1 + n_files))
    idf = np.log((1 + n_files) / (1 + frequency)) + 1e-9
    known = _Templates(np.array([k for k, _ in pairs]), counts, idf, most, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            data, offsets = flat(batch.column("_text"))
            found = words(data, offsets, LETTERS)
            term = _lookup(vocabulary, found.hashes)
            row = np.repeat(np.arange(batch.num_rows), np.diff(found.firsts))
            ends = np.flatnonzero(data == 10)
            line = np.searchsorted(ends, found.starts) + row  # rows begin new lines
            number = line - row - np.searchsorted(ends, offsets[row]) + 1  # from 1 in each row
            out = _Found(batch.num_rows)
            if len(row):
                distinct, at, group = np.unique(line, return_index=True, return_inverse=True)
                out.offer(row[at], *known.best(group, len(distinct), term), number[at])
                whole = batch.column("_whole").to_numpy(zero_copy_only=False).astype(bool)
                for inside, place in ((whole[row], None), (_header_words(data, offsets, ends, found.starts, row), number)):
                    distinct, at, group = np.unique(row[inside], return_index=True, return_inverse=True)
                    if len(distinct):
                        where = np.zeros(len(distinct), np.int64) if place is None else place[inside][at]
                        out.offer(distinct, *known.best(group, len(distinct), term[inside]), where)
                _groups(known, out, term, row, number, found.firsts, np.searchsorted(_cuts(data), found.starts) + row)
            label = [names[b] if s >= threshold else None for b, s in zip(out.label.tolist(), out.score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("given"), pa.array(label, pa.string()), pa.array(out.score), pa.array(out.place)], names=schema.fieldNames()
            )

    return rows.mapInArrow(run, schema).select(*(F.col(f"given.`{c}`") for c in kept), "license", "score", "line")


def _groups(known: _Templates, out: _Found, term: np.ndarray, row: np.ndarray, number: np.ndarray, firsts: np.ndarray, piece: np.ndarray) -> None:
    """Offers the groups of neighbouring pieces (lines and sentences) that are about as long as a template.

    From each piece on, the last end below the template's length and the first from it on.  Running sums bound the
    cosine from above (a norm is no less than its words' weights counted once each time); only groups whose bound
    could still win are worked out.  Templates of one length are bounded together first, by each word's largest
    weight in any of them, and one by one only in the rows that are left.
    """
    begin = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
    end = np.append(begin[1:], len(piece))
    owner = row[begin]
    last = np.searchsorted(owner, owner, "right") - 1  # the last piece of the row
    many = number[firsts[1:][owner] - 1] > number[firsts[:-1][owner]]  # words on several lines
    hit = term >= 0
    place, idf = np.where(hit, term, 0), np.append(known.idf, 0.0)
    norm = np.append(0.0, np.cumsum(np.where(hit, idf[place] ** 2, known.most**2)))
    term_or_none = np.where(hit, term, len(known.idf))
    for m in np.unique(known.length)[::-1].tolist():
        up = np.minimum(np.searchsorted(end, begin + m), last)
        at = np.concatenate([np.arange(len(begin))] * 2)
        to = np.concatenate([up, up - 1])
        fits = to >= at
        at, to = at[fits], to[fits]
        size = end[to] - begin[at]
        fits = (2 * size >= m) & (2 * size <= 3 * m)
        at, to = at[fits], to[fits]
        if not len(at):
            continue
        full = (to == last[at]) & (begin[at] == firsts[:-1][owner[at]]) & many[at]
        a, b, mine, where = begin[at], end[to], owner[at], np.where(full, 0, number[begin[at]])
        least = np.sqrt(np.maximum(norm[b] - norm[a], 1e-300))
        forms = np.flatnonzero(known.length == m)

        def bounds(dot: np.ndarray, some: np.ndarray) -> np.ndarray:
            """What the key of groups can be at most, from their dot products at most."""
            most = known.key(int(forms[0]), np.minimum(1.0, dot / least[some] + 1e-9), b[some] - a[some])
            return np.where(dot <= 1e-9, 0.0, most)

        def could(some: np.ndarray, bound: np.ndarray) -> np.ndarray:
            now = out.key[mine[some]]
            return (bound > now + 2e-9) | ((bound >= now) & (bound > 0) & (where[some] < out.place[mine[some]]))

        every = np.arange(len(a))
        sums = np.append(0.0, np.cumsum(np.append(known.unit[forms].max(0) * known.idf, 0.0)[term_or_none]))
        every = every[could(every, bounds(sums[b] - sums[a], every))]
        if not len(every):
            continue
        inside = np.zeros(len(firsts) - 1, bool)
        inside[mine[every]] = True
        inside = inside[row]
        words_left = term_or_none[inside]
        index = np.append(0, np.cumsum(inside))
        low, high = index[a[every]], index[b[every]]
        for t in forms.tolist():
            sums = np.append(0.0, np.cumsum(np.append(known.unit[t] * known.idf, 0.0)[words_left]))
            bound = bounds(sums[high] - sums[low], every)
            left = could(every, bound)
            some, bound = every[left], bound[left]
            order = np.lexsort((some, -bound, mine[some]))
            top = order[np.unique(mine[some][order], return_index=True)[1]]
            _offer_groups(known, out, t, term, a[some[top]], b[some[top]], mine[some[top]], where[some[top]])
            left = could(some, bound)
            left[top] = False
            some = some[left]
            _offer_groups(known, out, t, term, a[some], b[some], mine[some], where[some])


def _offer_groups(known: _Templates, out: _Found, t: int, term: np.ndarray, begin: np.ndarray, end: np.ndarray, row: np.ndarray, place: np.ndarray) -> None:
    """Works out groups of words, about ``WORK`` words at a time."""
    sizes = end - begin
    block = np.cumsum(sizes) // WORK
    for some in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(block)) + 1):
        if not len(some):
            continue
        n = sizes[some]
        group = np.repeat(np.arange(len(some)), n)
        word = np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[some], n)
        cosine = known.cosine(t, len(some), *_weights(group, len(some), term[word], known.idf, known.most))
        out.offer(row[some], known.key(t, cosine, n), np.full(len(some), known.label[t]), cosine, place[some])


def inherited(scanned: DataFrame, path: str = "path") -> DataFrame:
    """``scanned`` with ``origin``: its own path, or the licence file whose ``license`` it takes; null if none.

    Of several licence files in a directory the best score counts, then the smaller path.  Directories are taken
    once however many files they hold.  Files of null path inherit nothing.
    """
    kept = [c for c in scanned.columns if c != "origin"]
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    columns = [F.col(f"`{path}`").alias("path"), F.col("license"), F.col("score")]
    rows = scanned.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("given"), *columns)
    rows = durable(rows.withColumns({"dir": folder, "file": F.element_at(parts, -1)}))
    held = rows.where(F.col("license").isNotNull() & F.col("file").rlike(_NAME))
    best = held.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("path").alias("p"), F.col("license").alias("l"))).alias("b")).select(F.col("dir").alias("above"), "b")
    dirs = rows.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("above")))).alias("a")).select("dir", "a.*")
    nearest = above.join(best, "above").groupBy("dir").agg(F.max_by("b", "depth").alias("near"))
    own = F.col("license").isNotNull()
    taken = {"license": F.when(own, F.col("license")).otherwise(F.col("near.l"))}
    out = [taken.get(c, F.col(f"given.`{c}`")).alias(c) for c in kept]
    return rows.join(nearest, "dir", "left").select(*out, F.when(own, F.col("path")).otherwise(F.col("near.p")).alias("origin"))
