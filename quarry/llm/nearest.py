"""Approximate nearest neighbours by cosine: inverted lists scanned by adaptive dimension sampling.

Vectors are scaled to length 1 and rotated at random, so a few of their dimensions estimate a whole distance. Lists come
from k-means on a bounded sample (SAMPLE vectors); every vector is indexed. How many lists a query probes follows from
the same sample: so many that of the sample's own nearest neighbours the share RECALL lies in the lists probed.

A list is stored in slots of about SLOT vectors, one row each, as column blocks of STEP dimensions; a list of any size is
many slots. Slots are dealt out once. Queries come to them through the shared folder, by list, in two rounds: first to
their NEAREST lists, and then, with the k-th best distance found there as their bound, to the others that they probe.
After each column block a candidate whose partial distance, scaled to all dimensions, exceeds a query's bound by the
factor 1 + EPSILON / sqrt(dimensions so far) is abandoned (the hypothesis that it is nearer is rejected), and columns
that every query has abandoned are not read on. The survivors' cosines are computed on the original vectors in double
precision.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; nor do those whose
dimension is not the most frequent one (of equals the largest), nor null ids. Rows that repeat an id are vectors of
their own: each is a query of its own if the id is one, and a candidate for the others. Ties go to the smaller id. An
empty table, or one without usable vectors, gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.llm import common
from quarry.llm.aligned import by_block, keyed, located

K = 5
SAMPLE = 16_384
#: Share of the sample's nearest neighbours that must lie in the probed lists; queries of the sample that are asked; least lists probed.
RECALL, ASKED, LEAST_PROBED = 0.97, 256, 8
#: Lists of the first round.
NEAREST = 2
SLOT = 2048
STEP, EPSILON = 16, 3.0
#: What rounding to single precision may add to a squared distance in the column blocks.
SLACK = 1e-5
#: Queries that meet a slot at once, and pairs whose cosines are computed at once.
TOGETHER, PAIRS = 256, 1 << 14
SEED = 7


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(block, row, id, v, d) of the vectors that take part, of any dimension; v is array<float> if it is that, else array<double>."""
    kind = vectors.schema[vector_col].dataType
    exact = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    out = keyed(vectors, F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(exact).alias("v")).where("id is not null and v is not null")
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return out.where((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)).withColumn("d", F.size(v))


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; starts from random rows, empty lists start anew."""
    rng = np.random.default_rng(SEED)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(sample @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        empty = ~sums.any(axis=1)
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        c = _unit(sums)
    return c


def probes_for(sample: np.ndarray, centre: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """How many of the lists hold the share `recall` of the nearest neighbours that vectors of the sample have in it."""
    asked = np.random.default_rng(SEED).choice(len(sample), min(ASKED, len(sample)), replace=False)
    near = sample[asked] @ sample.T
    near[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if not k:
        return len(centre)
    found = np.argpartition(-near, k - 1, axis=1)[:, :k]
    own = np.argmax(sample @ centre.T, axis=1)[found]
    place = np.argsort(np.argsort(-(sample[asked] @ centre.T), axis=1), axis=1)
    return int(np.ceil(np.quantile(np.take_along_axis(place, own, axis=1), recall))) + 1


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with y in double precision; a row's value does not depend on the others."""
    a = np.abs(x).max(axis=1, keepdims=True)
    b = np.abs(y).max()
    x, y = x / a, y / b
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum()))


def _pair_cosines(base: np.ndarray, query: np.ndarray, rows: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of base[rows[i]] and query[asked[i]] in double precision, as `cosine` gives them."""
    out = []
    for i in range(0, len(rows), PAIRS):
        x, y = base[rows[i : i + PAIRS]], query[asked[i : i + PAIRS]]
        x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
        out.append((x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))))
    return np.concatenate(out) if out else np.zeros(0)


def scan(blocks: list[np.ndarray], rotated: np.ndarray, bound: np.ndarray, self_: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs of one slot that may be among the k nearest of their queries.

    blocks: the slot's column blocks; bound: each query's squared distance to beat; self_: a query's own row here, or -1."""
    d, m = rotated.shape[1], len(blocks[0])
    rows, own = np.arange(m), np.arange(len(rotated))
    part = np.zeros((len(own), m))
    has = np.flatnonzero(self_ >= 0)
    part[has, self_[has]] = np.inf
    lo = 0
    for block in blocks:
        hi = lo + block.shape[1]
        x, q = block[rows], rotated[own, lo:hi]
        part += np.maximum((x * x).sum(axis=1)[None, :] + (q * q).sum(axis=1)[:, None] - 2 * (q @ x.T), 0)
        lo = hi
        limit = bound[own] * (1 + EPSILON / np.sqrt(hi)) ** 2 * (hi / d) + SLACK if hi < d else bound[own] + SLACK
        part[part > limit[:, None]] = np.inf
        alive = np.isfinite(part)
        columns, lines = np.flatnonzero(alive.any(axis=0)), np.flatnonzero(alive.any(axis=1))
        if len(columns) < len(rows) or len(lines) < len(own):
            rows, own, part = rows[columns], own[lines], part[np.ix_(lines, columns)]
        if not part.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if part.shape[1] > k:
        part[part > np.partition(part, k - 1, axis=1)[:, k - 1 : k] + SLACK] = np.inf
    q, c = np.nonzero(np.isfinite(part))
    return own[q], rows[c]


def _best(query: np.ndarray, score: np.ndarray, ids: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """The k best of each query, by their place: by score, then id, then row."""
    order = np.lexsort((key[:, 1], key[:, 0], ids, -score, query))
    q = query[order]
    begin = np.concatenate(([True], q[1:] != q[:-1])) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.flatnonzero(begin)[np.cumsum(begin) - 1] if len(q) else np.zeros(0, np.int64)
    return order[rank < k]


def _slots(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """A row (list, slot, keys, ids, base, blocks) for each slot; rows come sorted by list and slot."""
    rotation = model.value[1]
    parts: list[tuple] = []
    key = None

    def row() -> pa.RecordBatch:
        keys, ids, base = (np.concatenate(x) for x in zip(*parts, strict=True))
        turned = _unit(base) @ rotation
        blocks = [np.ascontiguousarray(turned[:, lo : lo + STEP], np.float32).tobytes() for lo in range(0, turned.shape[1], STEP)]
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys, ids, base)), pa.array([blocks], pa.list_(pa.binary()))], names=["list", "slot", "keys", "ids", "base", "blocks"])

    for batch in batches:
        lists, slots = (batch.column(c).to_numpy() for c in ("list", "slot"))
        keys = np.column_stack([batch.column(c).to_numpy() for c in ("block", "row")])
        ids, vectors = batch.column("id").to_numpy(), _matrix(batch.column("v"))
        edge = np.flatnonzero(np.concatenate(([True], (lists[1:] != lists[:-1]) | (slots[1:] != slots[:-1]), [True]))) if len(ids) else []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            now = int(lists[i]), int(slots[i])
            if now != key and parts:
                yield row()
                parts = []
            key = now
            parts.append((keys[i:j], ids[i:j], vectors[i:j]))
    if parts:
        yield row()


def _assigned(batches: Iterator[pa.RecordBatch], model, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """Each vector once for each of its lists from the first-th to the last-th nearest, with the list in front."""
    centre = model.value[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = np.argsort(-(_unit(_matrix(batch.column("v"))) @ centre.T), axis=1, kind="stable")[:, first:last]
        again = pa.array(np.repeat(np.arange(batch.num_rows), lists.shape[1]))
        yield pa.RecordBatch.from_arrays([pa.array(lists.ravel().astype(np.int32)), *(batch.column(c).take(again) for c in batch.schema.names)], names=["list", *batch.schema.names])


def _found(batches: Iterator[pa.RecordBatch], path: str, model, k: int) -> Iterator[pa.RecordBatch]:
    """Slots (block: the list, row: 0, ...) against the queries at path that probe their lists: the k best of each query in each."""
    rotation = model.value[1]
    names = ["qblock", "qrow", "query_id", "vec_id", "block", "row", "score"]
    for slot, table in located(batches, path):
        if table is None:
            continue
        asked, asked_id = (np.column_stack([table.column(c).to_numpy() for c in ("qblock", "qrow")]), table.column("id").to_numpy())
        query, bound = _matrix(table.column("v").combine_chunks()), table.column("bound").to_numpy()
        rotated = _unit(query) @ rotation
        d = query.shape[1]
        for keys, ids, base, blocks in zip(*(slot.column(c).to_pylist() for c in ("keys", "ids", "base", "blocks")), strict=True):
            keys, ids, base = np.frombuffer(keys, np.int64).reshape(-1, 2), np.frombuffer(ids, np.int64), np.frombuffer(base).reshape(-1, d)
            columns = [np.frombuffer(b, np.float32).reshape(len(ids), -1).astype(np.float64) for b in blocks]
            place = {tuple(x): i for i, x in enumerate(keys.tolist())}
            self_ = np.array([place.get(tuple(x), -1) for x in asked.tolist()])
            for i in range(0, len(query), TOGETHER):
                q, c = scan(columns, rotated[i : i + TOGETHER], bound[i : i + TOGETHER], self_[i : i + TOGETHER], k)
                q = q + i
                score = _pair_cosines(base, query, c, q)
                best = _best(q, score, ids[c], keys[c], k)
                q, c, score = q[best], c[best], score[best]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (asked[q, 0], asked[q, 1], asked_id[q], ids[c], keys[c, 0], keys[c, 1], score)], names=names)


def search(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that is_query selects, by its column `id`.

    probes: how many lists each query probes; None: as many as RECALL asks for."""
    spark = vectors.sparkSession
    every = usable(vectors, id_col, vector_col)
    sizes = every.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()  # rows: one a dimension
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes["d"], sizes["count"]
    every = every.where(F.col("d") == d).drop("d")
    sample = np.array([r["v"] for r in every.orderBy(F.xxhash64("id"), "id", "block", "row").limit(SAMPLE).collect()], np.float64)  # SAMPLE rows at most
    unit = _unit(sample)
    centre = centroids(unit, max(1, min(round(n**0.5), len(unit) // 8)))
    probes = min(len(centre), max(LEAST_PROBED, probes_for(unit, centre, k)) if probes is None else max(1, probes))
    model = spark.sparkContext.broadcast((centre, _rotation(d)))  # at most SAMPLE / 8 + d rows of d numbers
    kind = every.schema["v"].dataType.simpleString()
    listed = lambda df, first, last, more="": df.mapInArrow(lambda it: _assigned(it, model, first, last), f"list int, block long, row long, id long, v {kind}{more}")
    base = common.written(listed(every, 0, 1), "lists")
    slots = F.broadcast(base.groupBy("list").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots")))  # one row a list
    dealt = base.join(slots, "list").select("list", F.pmod(F.xxhash64("block", "row"), F.col("slots")).cast("int").alias("slot"), "block", "row", "id", "v")
    dealt = dealt.repartition(common.shuffle_partitions(spark), "list", "slot").sortWithinPartitions("list", "slot")
    stored = common.written(dealt.mapInArrow(lambda it: _slots(it, model), "list int, slot int, keys binary, ids binary, base binary, blocks array<binary>"), "slots")
    stored = stored.select(F.col("list").cast("long").alias("block"), F.lit(0).cast("long").alias("row"), "keys", "ids", "base", "blocks")
    asked = every.where(is_query)

    def met(queries: DataFrame, name: str) -> DataFrame:
        path = by_block(queries.select(F.col("list").cast("long").alias("block"), F.lit(0).cast("long").alias("row"), F.col("block").alias("qblock"), F.col("row").alias("qrow"), "id", "v", "bound"), name)
        return common.written(stored.mapInArrow(lambda it: _found(it, path, model, k), "qblock long, qrow long, query_id long, vec_id long, block long, row long, score double"), f"found-{name}")

    first = met(listed(asked, 0, min(NEAREST, probes)).withColumn("bound", F.lit(float("inf"))), "nearest")
    by = Window.partitionBy("qblock", "qrow").orderBy(F.desc("score"), "vec_id", "block", "row")
    kth = first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") == k).select(F.col("qblock").alias("block"), F.col("qrow").alias("row"), (2 - 2 * F.col("score") + 1e-9).alias("bound"))
    found = first
    if probes > NEAREST:
        known = asked.join(kth, ["block", "row"], "left").select("block", "row", "id", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
        found = first.unionByName(met(listed(known, NEAREST, probes, ", bound double"), "others"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
