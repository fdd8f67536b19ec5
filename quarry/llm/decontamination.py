"""Benchmark decontamination, native: a broadcast hash set of benchmark n-grams against every token window of the corpus.

A document is one row; repeated rows and rows with null or repeated ids are documents of their own. Null and empty
texts have no words and are clean; texts of any length are scanned whole. Items that share an id count once; those with a
null id are such items too, and stand in the list of items as the empty string. An empty benchmark leaves every document
clean, and a table without documents gives none. Columns are picked by name, so extra columns never clash.

The set is broadcast while it has at most BROADCAST_ROWS windows (counted first). A larger one is joined by shuffling
keys: two 64-bit hashes of each window with its place, never the words of a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.llm.aligned import is_scan, keyed
from quarry.llm.common import BROADCAST_ROWS, lower_ascii, text_of

N = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(WORD), F.lit(0))


def _hash(array: str, position: Column, length: Column | int, lengths: list[int], seed: int = 0) -> Column:
    """A hash of `length` words from the position on; lengths: what `length` may be."""
    one = lambda k: F.xxhash64(F.lit(k + 1000 * seed), *(F.get(F.col(array), position + i) for i in range(k)))
    if isinstance(length, int):
        return one(length)
    return reduce(lambda e, k: e.when(length == k, one(k)), lengths[1:], F.when(length == lengths[0], one(lengths[0])))


def benchmark_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """(key, key2, len, gram, items): each distinct window of n words, or a shorter item's own words, with the items that hold it."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(n)))
    at = items.select("item", "len", "w", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("pos"))
    grams = at.select("item", "len", F.slice("w", F.greatest(F.col("pos"), F.lit(0)) + 1, F.col("len")).alias("gram"))
    grams = grams.groupBy("len", "gram").agg(F.sort_array(F.collect_set("item")).alias("items"))
    key = lambda seed: _hash("gram", F.lit(0), F.col("len"), list(range(1, n + 1)), seed)
    return grams.withColumn("key", key(0)).withColumn("key2", key(1))


def hits(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """For each row of documents (block, row, doc_id, n_words) and hits, an array of (pos, len, items) of its contaminated
    windows; block and row are its key as `aligned.keyed` gives it.

    One pass over the texts, for all lengths of windows. Each document gives one row of its own (position -1) and one for
    each window; a broadcast hash join on 64-bit keys keeps the windows that the benchmark may hold, and comparing the
    words confirms them, so a shared key never counts. Only confirmed windows and one short row a document are shuffled.
    """
    grams = common.written(benchmark_windows(benchmark, n), "grams")
    sizes = {r["len"]: r["rows"] for r in grams.groupBy("len").agg(F.count("*").alias("rows")).collect()}  # n rows at most
    lengths = sorted(sizes) or [n]
    docs = keyed(documents, F.col("doc_id"), words(F.col("text")).alias("w"))
    own = ["block", "row", "doc_id"]
    at = docs.select(*own, "w", F.explode_outer(F.sequence(F.lit(-1), F.greatest(F.size("w") - lengths[0], F.lit(-1)))).alias("pos"))
    length: Column | int = lengths[0]
    if len(lengths) > 1:
        fits = F.filter(F.array(*map(F.lit, lengths)), lambda k: (F.col("pos") < 0) & (k == lengths[0]) | (F.col("pos") >= 0) & (F.col("pos") + k <= F.size("w")))
        at, length = at.withColumn("len", F.explode(fits)), F.col("len")
    else:
        at = at.withColumn("len", F.lit(length))
    hit = F.when(F.col("pos") >= 0, F.struct("pos", "len", "items")).alias("hit")
    n_words = F.size("w").cast("long").alias("n_words")
    if sum(sizes.values()) <= BROADCAST_ROWS:
        at = at.withColumn("key", F.when(F.col("pos") >= 0, _hash("w", F.col("pos"), length, lengths)))
        known = F.broadcast(grams.select(F.col("len").alias("k"), "key", "gram", "items"))  # its size has just been counted
        found = at.join(known, (at["key"] == known["key"]) & (F.col("len") == F.col("k")) & (F.slice(at["w"], F.greatest(at["pos"], F.lit(0)) + 1, F.col("len")) == F.col("gram")), "left")
        found = found.where((F.col("pos") < 0) | F.col("items").isNotNull()).select(*own, n_words, hit)
    else:
        keys = at.where("pos >= 0").select(*own, "pos", "len", *(_hash("w", F.col("pos"), length, lengths, i).alias(k) for i, k in enumerate(("key", "key2"))))
        found = keys.join(grams.select("len", "key", "key2", "items"), ["len", "key", "key2"]).select(*own, F.lit(None).cast("long").alias("n_words"), hit)
        found = docs.select(*own, n_words, F.lit(None).cast(found.schema["hit"].dataType).alias("hit")).unionByName(found)
    return found.groupBy("block", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hit").alias("hits"))


def _covered() -> Column:
    """Word positions that the hits cover, each once."""
    return F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1))))


def contamination(documents: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(documents, benchmark, n).withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.col("hits.items")))))
    n_hit = F.size(_covered()).cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "spans") -> DataFrame:
    """documents without contaminated spans (the words go, with what stands before each) or without contaminated documents.

    All columns are kept; n_chars, if there is one, follows the new text. Clean documents are returned unchanged.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove is 'spans' or 'documents', not {remove!r}")
    documents = documents if is_scan(documents) else common.written(documents, "input")
    rows = keyed(documents, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("__doc"))
    found = common.written(hits(documents, benchmark, n).where(F.size("hits") > 0).select("block", "row", _covered().alias("__hit")), "hits")
    if common.small(found, F.size("__hit") * 4):  # else texts are shuffled, beside the many findings
        found = F.broadcast(found)
    if remove == "documents":
        return rows.join(found, ["block", "row"], "left_anti").select("__doc.*")
    both = rows.join(found, ["block", "row"], "left")
    # The text in pieces, each a word and what stands before it, then what follows the last word.
    text = text_of(F.col("__doc.text"))
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # A-Z are letters here: this text isn't lower-cased
    pieces = F.regexp_extract_all(text, F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*" + word), F.lit(0))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)$", 1)
    kept = F.concat(F.array_join(F.filter(pieces, lambda _, i: ~F.array_contains("__hit", i)), ""), tail)
    new = F.when(F.col("__hit").isNull(), F.col("__doc.text")).otherwise(kept)
    out = []
    for c in documents.columns:
        if c == "text":
            out.append(new.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("__hit").isNull(), F.col("__doc.n_chars")).otherwise(F.length(new)).cast(documents.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"__doc.`{c}`").alias(c))
    return both.select(*out)


SQL = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
g AS (
  SELECT DISTINCT item, least(len(w), 10) AS l, w[p : p + least(len(w), 10) - 1] AS gram
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (
  SELECT r, l, p, w[p : p + l - 1] AS gram
  FROM (SELECT r, l, w, unnest(generate_series(1, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l)),
h AS (SELECT r, p, p.l, item FROM p JOIN g ON p.l = g.l AND p.gram = g.gram),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + l - 1)) AS q FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
