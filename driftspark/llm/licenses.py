"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Templates are notices (a sentence), tags (``SPDX-License-Identifier: MIT``, one term with its
id; of an expression the first id counts) and full licence texts. A file whose whole text, of any
length, has a cosine of TF-IDF vectors of at least THRESHOLD to a template is its directory's
licence file and has the licence of the largest. Any other file has the licence of its line or
window with the largest cosine from THRESHOLD on (a header notice); the windows are all runs
of as many words as a notice has, so that notices may be wrapped over lines. Inverse document
frequencies of all terms, the templates' and others, are counted over all files. A window is
scored against the notices of its length, a line against all notices, and tags as notices of
one word; neither makes a licence file of a text that is a tag alone.

Lines and windows are found without scoring all: for each notice, the fewest heavy terms are
taken whose absence leaves less than THRESHOLD of its length, and words that have none of any
notice's cannot reach the bound; windows are made around such terms and go on if the terms
of the notice that they hold have that length. A whole text goes on if its dot product over
the length of its templates' terms alone, which is at least the cosine, reaches the bound.

A file without own licence takes that of the nearest ancestor directory that has one:
directories, one row each, are joined with their ancestors, and files with their directory.

Notices, texts (id to text) and tags (ids) are parameters. A text of a licence that has no
template can come out as a near relative (the full text of the AGPL as GPL, of ISC without its
proviso as ISC). The full texts of CC BY and CC BY-NC are not at hand, and CC BY-SA alone would
take their files, so that the three have notices and tags only.
Defined results: null and empty texts have no own licence; a null path lies in no directory;
ties go to the smaller licence id, then the earlier line (line is where a line or window
begins, -1 for whole texts); two licence files in a directory give the smaller id; repeated
rows are scanned each, rows without id like others; texts of any length are scanned whole;
columns other than the three named are not read, whatever their names. Everything is DataFrame functions.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared

THRESHOLD = 0.75
# Bound of the broadcast table of words and their weights, about 20 MB.
BROADCAST_WORDS = 200_000
# Short public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "ISC": "Released under the ISC License.",
    "Unlicense": "Released into the public domain under the Unlicense.",
    "Zlib": "Released under the zlib License.",
}
# Identifiers of the public list that tags may name.
TAGS = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0",
        "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "Zlib")
MARK = "spdx-license-identifier"
# Full texts as published, read with the module by the driver.
TEXTS = {f.name.removesuffix(".txt"): f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def tag_term(name: str) -> str:
    return "spdx" + "".join(plain_terms(name))


def tag_pattern(name: str) -> str:
    """Of a tag in lower case, alike in Java and Python; ``-only`` and ``-or-later`` belong to the id."""
    return MARK + r"[ \t]*:[ \t]*\(?" + re.escape(name.lower()) + r"(-only|-or-later|\+)?(?![a-z0-9+-]|\.[a-z0-9])"


def lowered(rows: DataFrame, text_col: str, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """``rows`` with the text in lower case, a tag with its id as one word, in column ``low``."""
    tagged = F.col("low")
    for name in tags:
        tagged = F.regexp_replace(tagged, tag_pattern(name), f" {tag_term(name)} ")
    return rows.withColumn("low", F.lower(text_col)).withColumn("low", F.when(F.contains("low", F.lit(MARK)), tagged).otherwise(F.col("low")))


def terms(low: Column) -> Column:
    """Runs of letters and digits."""
    return F.array_remove(F.split(low, "[^a-z0-9]+"), "")


def plain_terms(text: str) -> list[str]:
    return [w for w in "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()]


def template_vectors(templates: dict[str, str], idf: dict[str, float]) -> dict[str, dict[str, float]]:
    """Unit vectors of the templates."""
    out = {}
    for name, text in templates.items():
        raw = {w: n * idf[w] for w, n in Counter(plain_terms(text)).items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        out[name] = {w: v / size for w, v in raw.items()}
    return out


def needed_terms(vectors: dict[str, dict[str, float]], threshold: float) -> list[str]:
    """Terms of which a text must hold one to reach the threshold with any template."""
    found: set[str] = set()
    for vector in vectors.values():
        left = 1.0
        for w, v in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
            if left < threshold * threshold * (1 - 1e-9):
                break
            found.add(w)
            left -= v * v
    return sorted(found)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.transform(F.array(value), body)[0]


def _bag(words: Column) -> Column:
    """Distinct words with their counts, by sorting."""
    def runs(s: Column) -> Column:
        begins = F.filter(F.transform(s, lambda w, i: F.when((i == 0) | (w != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return _let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(s, i).alias("w"), (F.coalesce(F.get(b, k + 1), F.size(s)) - i).alias("tf"))))

    return _let(F.sort_array(words), runs)


def _windows(lines: Column, notices: list[tuple[int, dict[str, float]]], threshold: float) -> Column:
    """Runs of words, as many as a notice (count of words, vector) has, whose terms of the notice
    have THRESHOLD of its length: (line, n, words) like the lines. They begin up to a notice's
    length before a needed term."""
    any_needed = F.array(*map(F.lit, sorted({w for _, vec in notices for w in needed_terms({"": vec}, threshold)}))).cast("array<string>")
    notices = F.array(*[F.struct(F.lit(n).alias("n"), F.array(*map(F.lit, needed_terms({"": vec}, threshold))).alias("needed"),
                                 F.array(*[F.struct(F.lit(w).alias("w"), F.lit(v * v).alias("vv")) for w, v in vec.items()]).alias("terms"))
                        for n, vec in notices]).cast("array<struct<n:int,needed:array<string>,terms:array<struct<w:string,vv:double>>>>")
    enough = threshold * threshold * (1 - 1e-9)

    def of_text(words: Column, at: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(any_needed, w), i)), lambda i: i.isNotNull())

        def of_notice(hits: Column, t: Column) -> Column:
            own = F.filter(hits, lambda i: F.array_contains(t.needed, F.get(words, i)))
            last = F.greatest(F.lit(0), F.size(words) - t.n)
            starts = F.array_distinct(F.flatten(F.transform(own, lambda i: F.sequence(F.least(last, F.greatest(F.lit(0), i - t.n + 1)), F.least(last, i)))))
            made = F.transform(starts, lambda i: F.struct(F.get(at, i).alias("line"), t.n.alias("n"), F.slice(words, i + 1, t.n).alias("words")))
            return F.filter(made, lambda x: F.aggregate(F.filter(t.terms, lambda y: F.array_contains(x.words, y.w)), F.lit(0.0), lambda a, y: a + y.vv) >= enough)

        return _let(hits, lambda h: F.when(F.size(h) > 0, F.flatten(F.transform(notices, lambda t: of_notice(h, t)))).otherwise(F.array().cast("array<struct<line:int,n:int,words:array<string>>>")))

    words, at = F.flatten(F.transform(lines, lambda x: x.words)), F.flatten(F.transform(lines, lambda x: F.transform(x.words, lambda _: x.line)))
    return _let(F.struct(words.alias("w"), at.alias("at")), lambda x: of_text(x.w, x.at))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path",
                  templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, texts: dict[str, str] = TEXTS,
                  tags: tuple[str, ...] = TAGS) -> DataFrame:
    """(id, path, license, via, cosine, line) of every row; via is header, file, inherited or null."""
    spark = files.sparkSession
    rows = lowered(files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", tags)
    words = sorted({w for t in [*templates.values(), *texts.values()] for w in plain_terms(t)})
    frequencies = shared.staged(rows.select(F.explode(F.array_distinct(terms(F.col("low")))).alias("w")).groupBy("w").count(), "frequencies")
    counts = dict(frequencies.where(F.col("w").isin(words)).collect())  # one row per template term
    total = rows.count()
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in words}
    vectors, full = template_vectors(templates, idf), template_vectors(texts, idf)
    key = F.xxhash64("id", "path", "text").alias("key")

    # whole texts: bags of words meet the templates' terms only, one row of sums a text
    columns = [*vectors.values(), *full.values()]
    held = spark.createDataFrame([(w, idf[w], [v.get(w, 0.0) for v in columns]) for w in words], "w string, idf double, v array<double>")
    bags = rows.select(key, F.explode(_bag(terms(F.col("low")))).alias("x")).select("key", "x.w", "x.tf").join(F.broadcast(held), "w")
    x = F.col("tf") * F.col("idf")
    sums = bags.groupBy("key").agg(F.sum(x * x).alias("size"), *[F.sum(x * F.col("v")[i]).alias(f"d{i}") for i in range(len(columns))])
    bound = threshold * (1 - 1e-9)
    near = sums.where(F.greatest(*[f"d{i}" for i in range(len(columns))], F.lit(0.0)) >= bound * F.sqrt("size"))
    near = shared.staged(near.select("key"), "near")  # rows that repeat give a multiple of both sides

    marks = {n: {tag_term(n): 1.0} for n in tags}
    notices = [(len(plain_terms(templates[n])), vec) for n, vec in vectors.items() if vec] + [(1, vec) for vec in marks.values()]
    needed = F.array(*map(F.lit, sorted({w for _, vec in notices for w in needed_terms({"": vec}, threshold)}))).cast("array<string>")
    lines = F.filter(F.transform(F.split("low", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.lit(0).alias("n"), terms(x).alias("words"))), lambda x: F.size(x.words) > 0)
    def held_of(all_lines: Column) -> Column:
        held = F.filter(all_lines, lambda x: F.arrays_overlap(x.words, needed))
        return _let(held, lambda h: F.when(F.size(h) > 0, F.concat(h, _windows(all_lines, notices, threshold))).otherwise(h))

    held_lines = _let(lines, held_of)
    whole = F.array(F.struct(F.lit(-1).alias("line"), F.lit(0).alias("n"), terms(F.col("low")).alias("words")))
    parts = rows.select(key, F.explode(held_lines).alias("x")).select("key", "x.*")
    whole = shared.on_ids(rows.select(key, "low"), near, "key", "left_semi").select("key", F.explode(whole).alias("x")).select("key", "x.*")
    at = F.xxhash64("line", "n", "words").alias("at")
    parts = shared.staged(parts.unionByName(whole).select("key", "line", "n", at, "words").dropDuplicates(["key", "line", "at"]), "lines")
    weights = [(kind, len(plain_terms(templates[n])) if kind == 0 else 1, n, w, v)
               for kind, vecs in enumerate((vectors, full, marks)) for n, vec in vecs.items() for w, v in vec.items()]
    weights = spark.createDataFrame(weights, "kind int, size_words int, license string, w string, v double")
    known = frequencies.join(parts.select(F.explode("words").alias("w")).distinct(), "w", "left_semi")
    known = shared.staged(known.select("w", (F.log((1 + F.lit(total)) / (1 + F.col("count"))) + 1).alias("idf")), "idf")
    known = F.broadcast(known) if shared.small(known, BROADCAST_WORDS) else known
    tf = parts.select("key", "line", "n", "at", F.explode("words").alias("w")).groupBy("key", "line", "n", "at", "w").agg(F.count(F.lit(1)).alias("tf"))
    weighed = tf.join(known, "w").withColumn("x", F.col("tf") * F.col("idf"))
    size = weighed.groupBy("key", "line", "at").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    # full texts are for whole texts only, tags for parts only; a window (n > 0) meets notices of its length
    meets = "case kind when 1 then line = -1 when 2 then line <> -1 and n in (0, 1) else n in (0, size_words) end"
    dots = weighed.join(F.broadcast(weights), "w").where(meets).groupBy("key", "line", "at", "kind", "license").agg(F.sum(F.col("x") * F.col("v")).alias("dot"))
    cosine = dots.join(size, ["key", "line", "at"]).withColumn("cosine", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("cosine") >= threshold)
    order = F.struct((F.col("line") != -1).alias("part"), (-F.col("cosine")).alias("c"), "license", "line")
    best = cosine.groupBy("key").agg(F.min(order).alias("b"), F.max((F.col("line") == -1)).alias("is_file"))
    best = shared.staged(best.select("key", "b.license", (-F.col("b.c")).alias("cosine"), "b.line", "is_file"), "own")

    scanned = rows.select("id", "path", key, F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).alias("dir")).join(best, "key", "left")
    scanned = shared.staged(scanned, "scanned")
    dirs = scanned.where("dir is not null").select("dir").distinct()
    licensed = scanned.where("is_file and dir is not null").groupBy(F.col("dir").alias("up")).agg(F.min("license").alias("inherited"))
    names = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(names)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, 1, n), "/").alias("up")))
    nearest = (dirs.select("dir", F.explode(steps).alias("s")).select("dir", "s.depth", "s.up").join(licensed, "up")
               .groupBy("dir").agg(F.max(F.struct("depth", "inherited"))["inherited"].alias("inherited")))
    out = scanned.join(nearest, "dir", "left")
    via = F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(F.col("inherited").isNotNull(), "inherited")
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), F.coalesce("license", "inherited").alias("license"), via.alias("via"), "cosine", "line")


def op2_query(spark, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source and language."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return scan_licenses(docs.select("doc_id", "text", path.alias("path")))
