"""Language identification by hierarchical discrimination.

A text's features are the shares of its byte 2- and 3-grams (letters lower-cased, all else
one space, bytes beyond ASCII kept) in 2^BITS hash places. Two levels of one-versus-one
linear support vector machines decide: every pair of language families has one, and so has
every pair of languages of one family. The family that wins most of its duels is chosen,
then, among its languages, the one that wins most (ties: larger sum of margins, then the
smaller name).

Learning. Each duel is a group of rows of one shuffle and is fitted by dual coordinate
descent in its own task. At most SAMPLE texts per language take part, those with the
smallest hash of id and text, of the LANGUAGES most frequent languages; a family's duel
takes an equal share of each of its languages. So a group is bounded by parameters, not by
the data, while the counts that set the hash threshold cover all rows. Scoring reads each
whole text once, piece by piece, without a shuffle.

Defined results: null texts and texts without a letter are ``und`` with score 0, and teach
nothing; without learnt rows all are ``und``; with one learnt language every text with a
letter has it, score 1. Codes not in FAMILIES are families of their own. Rows without id
are judged but never learnt from; rows that repeat an id are judged each; copies (id and
text) count once in learning. Columns that are not named are kept by ``identify``; a column
of a result's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftspark.llm import shared, words
from driftspark.llm.quality import sigmoid_fit

BITS = 16
SAMPLE, LANGUAGES, SHARE_LEAST = 1500, 64, 50
COST, EPOCHS, DAMPING = 10.0, 30, 1e-4
# Language families by code.
FAMILIES = {code: family for family, codes in {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz tk ky tt",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa mr gu ne si",
    "iranian": "fa ku ps tg",
    "malayic": "id ms jv su tl",
}.items() for code in codes.split()}
# Byte classes: lower case, bytes beyond ASCII, and one space for all else.
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_SPACES = _FOLD == 32


def family(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return FAMILIES.get(code, f"={lang}")


# --- features ----------------------------------------------------------------------------

def grams(data: np.ndarray, offsets: np.ndarray, step: int = words.STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash place) of the grams of consecutive texts, in pieces of about ``step`` bytes."""
    data = data[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    for at in range(0, len(data), step):
        lead, back = at, 4
        while lead and lead == at or lead and (~_SPACES[data[lead + 1:at]] | ~_SPACES[data[lead:at - 1]]).sum() < 4:
            lead, back = max(0, at - back), back * 4  # a gram and a capital's first byte may reach back so far
        raw = data[lead:at + step]
        c = _FOLD[raw]
        text = np.searchsorted(offsets, np.arange(lead, lead + len(raw)), side="right") - 1
        # capitals of the Latin-1 letters, as two bytes in UTF-8
        capital = np.zeros(len(c), dtype=bool)
        capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        c = np.where(capital, c + 32, c).astype(np.uint32)
        same = text[1:] == text[:-1]
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = ~((c[1:] == 32) & (c[:-1] == 32) & same)
        # a run of spaces is one; a gram belongs to the piece that holds its last byte
        c, text, place = c[keep], text[keep], np.flatnonzero(keep) + lead
        if len(c) > 1:
            own = (text[1:] == text[:-1]) & (place[1:] >= at)
            pair = c[:-1] << np.uint32(8) | c[1:]
            yield text[1:][own], _place(pair[own] | np.uint32(1 << 24))
            if len(c) > 2:
                own3 = own[1:] & (text[2:] == text[:-2])
                yield text[2:][own3], _place(pair[:-1][own3] << np.uint32(8) | c[2:][own3])


def _place(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint32(0x9E3779B1)) ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)


def shares(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's hash places, and their shares of all its grams."""
    out = []
    for i in range(len(offsets) - 1):
        count = np.zeros(1 << BITS)
        for _, place in grams(data, offsets[i:i + 2]):
            count += np.bincount(place, minlength=1 << BITS)
        at = np.flatnonzero(count)
        out.append((at, count[at] / max(count.sum(), 1)))
    return out


def _vectors(batches):
    """(lang, tag, vector): places as 16 bits, shares as 32-bit floats."""
    for batch in batches:
        for lo, hi, data, offsets in words.slices(batch.column(2)):
            got = [at.astype(np.uint16).tobytes() + share.astype(np.float32).tobytes() for at, share in shares(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(got, pa.binary())],
                                             names=["lang", "tag", "vector"])


def _read(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(vector) // 6
    return np.frombuffer(vector, np.uint16, n).astype(np.int64), np.frombuffer(vector, np.float32, n, 2 * n).astype(np.float64)


# --- duels -------------------------------------------------------------------------------

def descend(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the squared-hinge support vector machine, by dual coordinate descent."""
    weights, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    half = {s: 0.5 / (2 * cost * len(rows) / (2 * max((sign == s).sum(), 1))) for s in (1.0, -1.0)}
    diagonal = np.array([half[s] for s in sign])
    norm = np.array([(v * v).sum() + 1.0 for _, v in rows]) + diagonal
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            gradient = sign[i] * (weights[at] @ v + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / norm[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * sign[i]
                weights[at] += change * v
                bias += change
                moved = max(moved, abs(gradient))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights, bias


def fit_duel(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Weights of shares, bias, and the curve of held-back margins, of one duel."""
    mean = np.zeros(1 << BITS)
    for at, v in rows:
        mean[at] += v
    scale = 1 / np.sqrt(mean / max(len(rows), 1) + DAMPING)
    scaled = [(at, v * scale[at]) for at, v in rows]
    y = (sign > 0).astype(np.int64)
    fold, held = np.arange(len(rows)) % 2, np.zeros(len(rows))
    slope, shift = 2.0, 0.0
    if min(y.sum(), len(y) - y.sum()) >= 8:
        for k in (0, 1):
            part = np.flatnonzero(fold != k)
            if len(np.unique(sign[part])) == 2:
                w, b = descend([scaled[i] for i in part], sign[part])
                held[fold == k] = [w[scaled[i][0]] @ scaled[i][1] + b for i in np.flatnonzero(fold == k)]
        slope, shift = sigmoid_fit(held, y)
    w, b = descend(scaled, sign)
    return w * scale, b, float(slope), float(shift)


def _fit(table: pa.Table) -> pa.Table:
    """One duel's rows, in the order of their tags, to its model."""
    order = np.lexsort((table.column("sign").to_numpy(), table.column("tag").to_numpy()))
    sign = table.column("sign").to_numpy()[order].astype(np.float64)
    vectors = table.column("vector").to_pylist()
    w, b, slope, shift = fit_duel([_read(vectors[i]) for i in order], sign)
    return pa.table({"duel": table.column("duel").slice(0, 1), "weights": pa.array([w.astype(np.float32).tobytes()], pa.binary()),
                     "bias": pa.array([b]), "slope": pa.array([slope]), "shift": pa.array([shift])})


def duels(langs: list[str]) -> list[tuple[int, str, str]]:
    """(level, one, other): level 0 between families, level 1 between languages of one."""
    families = sorted({family(x) for x in langs})
    found = [(0, a, b) for i, a in enumerate(families) for b in families[i + 1:]]
    for f in families:
        own = sorted(x for x in langs if family(x) == f)
        found += [(1, a, b) for i, a in enumerate(own) for b in own[i + 1:]]
    return found


def learn(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """The model of labelled rows: languages, duels, and a list of fitted duels."""
    spark = rows.sparkSession
    rows = rows.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(id_col, text_col, F.lit(12)).alias("tag"), F.col(text_col).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()  # a row per language
    langs = sorted(r.lang for r in counts)
    pairs = duels(langs)
    if not pairs:
        return {"langs": langs, "duels": [], "fitted": []}
    # a hash below its language's threshold is expected for a quarter more than the sample
    limits = spark.createDataFrame([(r.lang, min(1.0, 1.25 * (sample + 40) / r.n)) for r in counts], "lang string, share double")
    near = F.pmod("tag", F.lit(1 << 40)) <= F.col("share") * F.lit(float(1 << 40))
    taken = rows.join(F.broadcast(limits), "lang").where(near).select("lang", "tag", "text").mapInArrow(_vectors, "lang string, tag long, vector binary")
    taken = taken.groupBy("lang", "tag").agg(F.first("vector").alias("vector"))
    order = Window.partitionBy("lang").orderBy(F.pmod("tag", F.lit(1 << 40)), "tag")
    taken = shared.staged(taken.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= sample), "taken")
    size = {f: sum(family(x) == f for x in langs) for f in {family(x) for x in langs}}
    part = []
    for number, (level, a, b) in enumerate(pairs):
        for x in langs:
            name = x if level else family(x)
            if name in (a, b) and (not level or family(x) == family(a)):
                part.append((x, number, 1 if name == a else -1, sample if level else max(SHARE_LEAST, sample // size[family(x)])))
    roles = spark.createDataFrame(part, "lang string, duel int, sign int, most int")
    fitted = (taken.join(F.broadcast(roles), "lang").where("nth <= most").select("duel", "sign", "tag", "vector")
              .groupBy("duel").applyInArrow(_fit, "duel int, weights binary, bias double, slope double, shift double").collect())
    return {"langs": langs, "duels": pairs, "fitted": [tuple(r) for r in fitted]}


# --- judging -----------------------------------------------------------------------------

def _winner(names: list[str], chance: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``names`` wins most duels in each of ``n`` texts, and its least chance."""
    if len(names) == 1:
        return np.zeros(n, dtype=np.int64), np.ones(n)
    wins, total, least = np.zeros((len(names), n)), np.zeros((len(names), n)), np.ones((len(names), n))
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            if i != j:
                p = chance[a, b] if (a, b) in chance else 1 - chance[b, a]
                wins[i] += p > 0.5
                total[i] += p
                least[i] = np.minimum(least[i], p)
    # names are sorted, so the first of equal ones is the smaller name
    best = np.argmax(wins + total / (2 * len(names)), axis=0)
    return best, np.take_along_axis(least, best[None], axis=0)[0]


class Judge:
    """The fitted duels as arrays; judges consecutive texts."""

    def __init__(self, model: dict):
        self.langs = model["langs"]
        self.pairs = [model["duels"][d] for d, *_ in model["fitted"]]
        self.weights = [np.frombuffer(w, np.float32) for _, w, *_ in model["fitted"]]
        self.curves = [rest for _, _, *rest in model["fitted"]]
        self.families = sorted({family(x) for x in self.langs})

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        sums, count = np.zeros((len(self.pairs), n)), np.zeros(n)
        for text, place in grams(data, offsets):
            count += np.bincount(text, minlength=n)
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                for s, w in zip(sums, self.weights):
                    s[text[first]] += np.add.reduceat(w[place], first, dtype=np.float64)
        chance = {}
        for (level, a, b), s, (bias, slope, shift) in zip(self.pairs, sums, self.curves):
            margin = s / np.maximum(count, 1) + bias
            chance[level, a, b] = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -500, 500)))
        of_level = lambda k: {(a, b): p for (level, a, b), p in chance.items() if level == k}
        kin, score = _winner(self.families, of_level(0), n)
        out = np.empty(n, dtype=object)
        for f, name in enumerate(self.families):
            own = [x for x in self.langs if family(x) == name]
            best, least = _winner(own, of_level(1), n)
            mine = kin == f
            out[mine] = np.array(own, dtype=object)[best[mine]]
            score = np.where(mine, score * least, score)
        return out.tolist(), score


def identify(docs: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, of every whole text."""
    docs = docs.drop(*[c for c in (lang_out, score_out) if c != text_col])
    letter = "_has_letter"
    read = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    arrow, at = to_arrow_schema(out), docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(held.value)
        for batch in batches:
            lang, score = [], []
            for _, _, data, offsets in words.slices(batch.column(at)):
                got = judge(data, offsets) if judge.langs else ([None] * (len(offsets) - 1), np.zeros(len(offsets) - 1))
                lang += got[0]
                score.append(got[1])
            known = batch.column(len(batch.columns) - 1).to_numpy(zero_copy_only=False).astype(bool) & bool(judge.langs)
            score = np.concatenate(score) if score else np.zeros(0)
            lang = [x if k else "und" for x, k in zip(lang, known)]
            columns = [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(known, score, 0.0))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return read.mapInArrow(run, out)


def held_out(id_col: str) -> F.Column:
    """Rows kept from learning: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    model = learn(docs.where(~held_out("doc_id")).select("doc_id", "text", "lang"))
    judged = identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
