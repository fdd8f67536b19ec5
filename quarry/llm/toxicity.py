"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned too, so it holds for any language that the labels cover: words, and beginnings of words, that are
far more frequent in texts labelled toxic. Labelled rows, a sample of at most ROWS, are dealt to FOLDS folds by a hash of
doc_id and everything is cross-fitted, at every size alike: a row's features come from a lexicon of the other folds, and
its margin, for the calibration, from trees of the other folds. The model that scores has the lexicon and the trees of
all folds. Lexicon and model are of bounded size and broadcast.

Features, all from the text alone: densities of lexicon words and their weights, how near a second-person pronoun stands
to one, capitals, punctuation, digits, obfuscated and elongated words, and length.

Defined cases: a null text counts as empty and gets a score like any other; labels that are null or without doc_id are
ignored, repeated ones count once, contradicting ones each. Without labels of both kinds all scores are 0. Rows are
scored one by one, so repeated rows get equal scores; an empty table gives none. Texts of any length are scored whole, in
memory that follows the text. Extra columns are ignored.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quarry.llm import common

ROWS, LEXICON, FOLDS = 30_000, 4096, 3
#: A lexicon entry occurs in at least so many toxic texts, and is so much more frequent there (log).
LEAST_TEXTS, LEAST_WEIGHT, STRONG = 3, 1.0, 3.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.7
CACHE = 200_000
#: Second-person words (fixed values).
SECOND_PERSON = frozenset("you your yours yourself yourselves u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
#: Characters that stand for letters in disguised words (fixed values).
DISGUISES = str.maketrans("013457@$!", "oieastasi")
FEATURES = ["hits", "strong", "strong_density", "weight", "weight_density", "top", "distinct", "near_second_person", "second_person", "capitals", "punctuation", "exclamations", "digits", "obfuscated", "obfuscated_hits", "elongated", "log_words"]

_CLASS = np.zeros(256, np.int64)  # 1 capitals, 2 letters and other bytes, 3 digits, 4 exclamation marks, 5 other punctuation
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
for _c in b"\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 5
_CLASS[33] = 4

_OPENS, _CLOSES = "\"#%&'()*+,-./:;<=>?[\\]^_`{|}~!", string.punctuation
_LONG = re.compile(r"(.)\1\1").search


def plain(token: str) -> tuple[str, bool]:
    """A token in lower case without what stands around its letters, and whether it was obfuscated inside."""
    word = token.lower()
    if word.isalpha():
        return word, False
    i, j = 0, len(word)
    while i < j and not word[i].isalnum() and word[i] not in "@$":
        i += 1
    while j > i and not word[j - 1].isalnum():
        j -= 1
    word = word[i:j]
    if not word or word.isalpha() or not any(c.isalpha() for c in word):
        return word, False
    letters = "".join(c for c in word.translate(DISGUISES) if c.isalpha())
    return letters, len(letters) * 2 > len(word)


def entries(word: str) -> list[str]:
    """What the lexicon may hold of a word: itself, and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


def fold_of(doc_id: int) -> int:
    return zlib.crc32(f"fold {doc_id}".encode()) % FOLDS


class Features:
    """Turns texts into rows of FEATURES; what it finds about a token is kept, up to CACHE tokens."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.table = np.zeros((CACHE // 4, 4))  # weight, second person, obfuscated, elongated

    def _add(self, token: str) -> int:
        word, obfuscated = token.lower(), False
        if not word.isalpha():
            word = word.lstrip(_OPENS).rstrip(_CLOSES)
            if word and not word.isalpha():
                word, obfuscated = plain(token)
        get = self.lexicon.get
        i = self.ids[token] = len(self.ids)
        if i == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        weight = max(get(f"={word}", 0.0), *(get(word[:n], 0.0) for n in PREFIXES))
        self.table[i] = weight, word in SECOND_PERSON, obfuscated, _LONG(word) is not None
        return i

    def row(self, text: str) -> np.ndarray:
        if len(self.ids) > CACHE:
            self._clear()
        tokens = text.split()
        found = list(map(self.ids.get, tokens))
        if None in found:
            found = [self.ids[t] if t in self.ids else self._add(t) for t in tokens]
        ids = np.array(found, np.int64)
        out = np.zeros(len(FEATURES))
        n = len(tokens)
        data = common.as_bytes(text)
        kinds = np.bincount(_CLASS[data], minlength=6) if len(data) else np.zeros(6, np.int64)
        letters, size = max(1, kinds[1] + kinds[2]), max(1, len(data))
        out[9:13] = kinds[1] / letters, (kinds[4] + kinds[5]) / size, kinds[4] / size, kinds[3] / size
        out[16] = np.log1p(n)
        if not n:
            return out
        found = self.table[ids]
        weight = found[:, 0]
        hit = np.flatnonzero(weight > 0)
        out[8], out[13], out[15] = found[:, 1].mean(), found[:, 2].mean(), found[:, 3].mean()
        if len(hit):
            strong = hit[weight[hit] >= STRONG]
            out[0], out[1], out[2] = len(hit) / n, len(strong), len(strong) / n
            out[3], out[4], out[5] = weight[hit].sum(), weight[hit].sum() / n, weight[hit].max()
            out[6] = len(np.unique(ids[strong]))
            out[14] = found[hit, 2].sum()
            you = np.flatnonzero(found[:, 1])
            if len(you) and len(strong):
                after = np.searchsorted(you, strong)
                gap = np.minimum(np.abs(strong - you[np.clip(after, 0, len(you) - 1)]), np.abs(strong - you[np.clip(after - 1, 0, len(you) - 1)]))
                out[7] = 1 / (1 + gap.min())
        return out


class Boosted:
    """Gradient-boosted regression trees for the logistic loss, grown level by level on quantile bins."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.concatenate((np.quantile(c, np.linspace(0, 1, self.bins)[1:-1]), np.unique(c[c > c.min()])[:2]))) if len(c) else np.zeros(0) for c in x.T]
        b = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])  # bin i: edges[i-1] < value <= edges[i]
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.start = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.start)
        self.grown: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            node = np.zeros(len(y), np.int64)
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gain = np.zeros(count)
                at = node - first
                for j, edges in enumerate(self.edges):
                    m = len(edges) + 1
                    if m == 1:
                        continue
                    key = at * m + b[:, j]
                    sg = np.bincount(key, g, count * m).reshape(count, m).cumsum(axis=1)
                    sh = np.bincount(key, h, count * m).reshape(count, m).cumsum(axis=1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    left, right = sg[:, :-1] ** 2 / (sh[:, :-1] + self.ridge), (tg - sg[:, :-1]) ** 2 / (th - sh[:, :-1] + self.ridge)
                    better = left + right - tg**2 / (th + self.ridge)
                    better[(sh[:, :-1] < self.least) | (th - sh[:, :-1] < self.least)] = 0
                    k = better.argmax(axis=1)
                    best = better[np.arange(count), k]
                    more = best > gain + 1e-9
                    gain[more] = best[more]
                    feature[first : first + count][more] = j
                    cut[first : first + count][more] = edges[k[more]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge) * self.rate
            self.grown.append((feature, cut, value))
            f += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.grown:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: margins and the calibrated probability there, to be interpolated. Each pool is drawn
    slightly to the whole rate, so that pools of one label do not claim certainty."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []  # sum of labels, rows, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    base = float(y.mean()) if len(y) else 0.0
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + base) / (p[1] + 1) for p in pools])


class Model:
    def __init__(self, lexicon: dict[str, float], boosted: Boosted | None, knots: tuple[np.ndarray, np.ndarray] | None) -> None:
        self.lexicon, self.boosted, self.knots = lexicon, boosted, knots

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Calibrated scores; within a pool a trace of the margin keeps the order of the rows."""
        if self.boosted is None or not len(features):
            return np.zeros(len(features))
        margin = self.boosted.margin(features)
        return np.clip(0.999 * np.interp(margin, *self.knots) + 0.001 / (1 + np.exp(-margin)), 0, 1)


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, fold) of at most ROWS labels, the first by a hash of doc_id."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    fold = (F.crc32(F.concat(F.lit("fold "), F.col("doc_id").cast("string")).cast("binary")) % FOLDS).cast("int")
    return known.where(~held_out(F.col("doc_id"))).withColumn("fold", fold).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(ROWS)


def _texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(labels), "doc_id")  # labels: a bounded sample


def learn_lexicons(documents: DataFrame, labels: DataFrame) -> list[dict[str, float]]:
    """Lexicons without each fold in turn, then of all. Entries by weight: the log ratio of an entry's share of toxic texts
    to its share of others, above LEAST_WEIGHT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic, fold in common.record_batches(batch):
                words = {plain(t)[0] for t in (text or "").split()}
                found = sorted({e for w in words if w for e in entries(w)} | {""})
                kind = 2 * fold + int(toxic > 0)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([kind] * len(found), pa.int32())], names=["entry", "kind"])

    counts = _texts(documents, labels).select("text", "toxic", "fold").mapInArrow(run, "entry string, kind int").groupBy("entry")
    counts = counts.agg(*(F.sum((F.col("kind") == 2 * f + bad).cast("long")).alias(f"{'bad' if bad else 'good'}{f}") for f in range(FOLDS) for bad in (0, 1)))
    every = sum((F.col(f"bad{f}") for f in range(FOLDS)), F.lit(0))
    counts = common.written(counts.where((every >= LEAST_TEXTS) | (F.col("entry") == "")), "lexicon")
    total = counts.where("entry = ''").first()
    out = []
    for without in (*range(FOLDS), None):
        folds = [f for f in range(FOLDS) if f != without]
        bad_all, good_all = (0 if total is None else sum(total[f"{c}{f}"] for f in folds) for c in ("bad", "good"))
        if not bad_all or not good_all:
            out.append({})
            continue
        bad, good = (sum((F.col(f"{c}{f}") for f in folds), F.lit(0)) for c in ("bad", "good"))
        weight = F.log((bad + 0.5) / (bad_all + 1)) - F.log((good + 0.5) / (good_all + 1))
        top = counts.where("entry <> ''").select("entry", bad.alias("bad"), weight.alias("weight")).where((F.col("bad") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT))
        out.append({r["entry"]: r["weight"] for r in top.orderBy(F.desc(F.col("bad") * F.col("weight")), "entry").limit(LEXICON).collect()})
    return out


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    spark = documents.sparkSession
    common.bound_batches(spark)
    labels = common.written(_labelled(labels), "labelled")
    lexicons = learn_lexicons(documents, labels)
    kept = spark.sparkContext.broadcast(lexicons)  # FOLDS + 1 times LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = [Features(x) for x in kept.value[:-1]]  # a row's own fold has no part in its features
        for batch in batches:
            rows = [features[f].row(t or "").tolist() for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    some = _texts(documents, labels).select("doc_id", "text", "toxic", "fold").mapInArrow(run, "doc_id long, toxic int, x array<double>")
    rows = some.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "toxic").limit(ROWS).collect()  # repeated ids may give more rows than labels
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"], r["x"]))
    fold = np.array([fold_of(r["doc_id"]) for r in rows])
    x, y = np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([float(r["toxic"] > 0) for r in rows])
    if len(np.unique(y)) < 2:
        return Model(lexicons[-1], None, None)
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        own, others = fold == f, fold != f
        if own.any():  # without both labels in the other folds their rate alone is the margin
            margin[own] = Boosted().fit(x[others], y[others]).margin(x[own]) if others.any() else 0.0
    return Model(lexicons[-1], Boosted().fit(x, y), isotonic(margin, y))


def scored(documents: DataFrame, model: Model, *columns: str) -> DataFrame:
    """The columns, then score (0 to 1) and predicted (1 if score >= THRESHOLD) of each row's text. A text goes to Python once."""
    spark = documents.sparkSession
    common.bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # at most LEXICON entries and the trees
    own = documents.select(*(F.col(f"`{c}`") for c in columns))
    sent = own if "text" in columns else documents.select(*(F.col(f"`{c}`") for c in columns), "text")
    at = sent.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value.lexicon)
        for batch in batches:
            x = np.array([features.row(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            score = shared.value.scores(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(columns))), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*columns, "score", "predicted"])

    return sent.mapInArrow(run, StructType([*own.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    out = scored(documents, fit(documents, labels), "doc_id")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
