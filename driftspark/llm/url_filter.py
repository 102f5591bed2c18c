"""URL filters: host and path rules, then gradient-boosted trees on lexical features.

A rule fits its host and all subdomains if the URL's path starts with the rule's path; the
longest fitting rule decides. From labelled URLs (a table of them, else those that a rule decides) a
model learns lexical features (lengths, depth, digit ratio, entropy, counts of parameters,
labels and hyphens, and the smoothed share of blocked URLs of the host's last label,
last two labels and the path's first part), and decides the rest. These shares cover all labelled URLs, each once. What
trains the trees has its shares from the other FOLDS - 1 folds of labelled URLs, so they don't give
its label away (leaving out only the URL itself would: its share falls by its own label). The
trees are fitted on at most SAMPLE distinct ones, those with the smallest hash.

Everything is DataFrame functions and Spark's own ML library; no Python runs in tasks.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule
and is judged by the model on its features; where labelled URLs have one class only, or
there are none, the model's verdict is that class, or allow. Repeated rows are judged each. A URL
labelled both ways counts as blocked; labels without URL or verdict are left out. URLs of any
length are read whole.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftspark.llm import shared

SAMPLE, TREES, DEPTH, FOLDS = 4000, 12, 4, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
FEATURES = ("f_length", "f_host", "f_path", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_fragment", "f_last", "f_last2", "f_first")
SHARES = ("last", "last2", "first")


def split_url(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    return (F.translate(F.regexp_extract(known, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(known, "://[^/?#]*([^?#]*)", 1))


def ruled(rules) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (null where none fits)."""
    longest_first = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p) for h, p, _ in longest_first]
    pick = lambda values: F.coalesce(*[F.when(f, F.lit(v)) for f, v in zip(fits, values)], F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in longest_first]), pick([v for *_, v in longest_first])


def entropy(text: Column) -> Column:
    """Bits per character, from the counts of the distinct characters."""
    n = F.length(text).cast("double")

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    letters = F.filter(F.array_distinct(F.split(text, "")), lambda c: F.length(c) > 0)
    return F.when(n > 0, F.aggregate(F.transform(letters, part), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0)


def lexical(pages: DataFrame, url: str) -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    count = lambda c, mark: (F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))).cast("double")
    return pages.select(
        "*", F.substring_index(host, ".", -1).alias("last"), F.substring_index(host, ".", -2).alias("last2"), F.regexp_extract(path, "^/([^/]*)", 1).alias("first"),
        F.length(u).cast("double").alias("f_length"), F.length(host).cast("double").alias("f_host"), F.length(path).cast("double").alias("f_path"),
        count(path, "/").alias("f_depth"), (F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1))).alias("f_digits"),
        entropy(u).alias("f_entropy"), F.when(F.instr(u, "?") > 0, count(u, "&") + 1).otherwise(0.0).alias("f_params"),
        count(host, ".").alias("f_labels"), count(u, "-").alias("f_hyphens"), (F.instr(u, "#") > 0).cast("double").alias("f_fragment"))


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, sample: int = SAMPLE, labels: DataFrame | None = None) -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule``, ``verdict`` and ``block_score`` (the model's).
    ``labels``: (url, verdict) to learn from in place of the URLs that a rule decides."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_score")]
    host, path = split_url(F.col(url_col))
    rule, verdict = ruled(rules)
    page = F.struct(*keep).alias("_page")
    seen = pages.select(page, F.col(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    seen = lexical(seen.select("*", rule.alias("rule"), verdict.alias("by_rule")), "_url")
    if labels is None:
        known = seen.withColumn("_label", F.col("by_rule"))
    else:
        host, path = split_url(F.col("url"))
        known = lexical(labels.select(F.col("url").alias("_url"), F.col("verdict").alias("_label"), host.alias("host"), path.alias("path")), "_url")
    labelled = shared.staged(known.where("_url is not null and _label is not null")
                             .groupBy("_url", *SHARES, *[f for f in FEATURES if f[2:] not in SHARES])
                             .agg(F.max((F.col("_label") == "block").cast("double")).alias("_own"))
                             .withColumn("_fold", F.pmod(F.xxhash64("_url", F.lit(1)), F.lit(FOLDS))), "labelled")
    classes = {r["_own"] for r in labelled.select("_own").distinct().collect()}

    def with_shares(df: DataFrame, training: bool = False) -> DataFrame:
        for name in SHARES:
            count = (F.sum("_own").alias("_s"), F.count(F.lit(1)).alias("_c"))
            df = df.join(labelled.groupBy(name).agg(*count), name, "left")
            if training:
                own = labelled.groupBy(name, "_fold").agg(*count).withColumnsRenamed({"_s": "_fs", "_c": "_fc"})
                df = df.join(own, [name, "_fold"]).withColumn("_s", F.col("_s") - F.col("_fs")).withColumn("_c", F.col("_c") - F.col("_fc")).drop("_fs", "_fc")
            df = df.withColumn(f"f_{name}", F.coalesce((F.col("_s") + 1) / (F.col("_c") + 2), F.lit(0.5))).drop("_s", "_c")
        return df

    if len(classes) < 2:
        scored = seen.withColumn("block_score", F.lit(next(iter(classes), 0.0)))
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        chosen = labelled.orderBy(F.xxhash64("_url"), "_url").limit(sample)
        train = shared.staged(with_shares(chosen, training=True).select(*FEATURES, F.col("_own").alias("label")), "training")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7).fit(rows.transform(train))
        from pyspark.ml.functions import vector_to_array

        scored = trees.transform(rows.transform(with_shares(seen))).withColumn("block_score", vector_to_array("probability")[1])
    learnt = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("_page.*", "host", "path", "rule", F.coalesce("by_rule", learnt).alias("verdict"), "block_score")


def op7_query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "block_score")
