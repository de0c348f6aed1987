"""Embedding near-dedup by spherical-cap filters with structured random product codes.

The coordinates, turned by a random rotation, are split into blocks, and each block has a small code of random unit
vectors. A filter is one code word from each block; its direction is their concatenation. A vector is in a filter if its
inner product with the direction is alpha or more, or within `slack` of its best filter's if that is low. List decoding
finds all such filters of a vector without going through the product of the codes: partial sums that cannot reach alpha
any more are cut. Alpha and slack shrink with the square root of the dimension, as inner products do.

Vectors are joined on their filters in two steps. In the first only ids and 128-bit sketches (the signs of random
projections) travel: an entry lives on if some other vector of its filter has a sketch so close that the cosine may reach
the threshold. In the second the living entries get their vectors, and are compared exactly, in double precision.

Exact copies of a vector are one node with a multiplicity. Filters are joined in blocks of bounded size, and a pair
counts in the smallest filter that both its vectors are in, so links are counted once and never become a table of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cleanloom.llm._common import bounded_batches, cut, joined, shipped
from cleanloom.llm._components import connected_components

shipped(__name__)

#: Vectors in a block of a filter that are compared at once; bits of a sketch; vectors that are decoded at once; filters that
#: are looked up at once.
BLOCK, BITS, DECODED, NAMES = 512, 128, 128, 4096
#: Bits of a filter's name that number it among those of its dimension; the dimension stands above them.
NUMBER = 40


def codes(dim: int, blocks: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The rotation, and the code words (block, word, coordinate), each of length 1 / sqrt(blocks)."""
    draw = np.random.default_rng(seed)
    padded = -(-dim // blocks) * blocks
    rotation = np.linalg.qr(draw.standard_normal((padded, padded)))[0][:dim]
    code = draw.standard_normal((blocks, words, padded // blocks))
    return rotation, code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(blocks)


def decode(x: np.ndarray, rotation: np.ndarray, code: np.ndarray, alpha: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) for each filter that a unit vector x[row] is in; all of them, by cutting hopeless prefixes.

    A vector that lies badly to the code, so that its best filter stays near alpha or below, takes those within slack of its best.
    """
    blocks, words, width = code.shape
    parts = np.einsum("nbw,bkw->nbk", (x @ rotation).reshape(len(x), blocks, width), code)
    best = parts.max(2)
    rest = np.cumsum(best[:, ::-1], axis=1)[:, ::-1]  # the most that blocks from here on can add
    least = np.minimum(alpha, rest[:, 0] - slack)
    row, name, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for b in range(blocks):
        later = rest[:, b + 1] if b + 1 < blocks else np.zeros(len(x))
        sums = total[:, None] + parts[row, b]
        at, word = np.nonzero(sums + later[row][:, None] >= least[row][:, None])
        row, name, total = row[at], name[at] * words + word, sums[at, word]
    return row, name


def _unit(vectors: list[bytes], kind: str) -> np.ndarray:
    x = np.array([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shape(dim: int, words: int, alpha: float, slack: float) -> tuple[int, float, float]:
    """Code words of a block, alpha and slack for vectors of so many dimensions; blocks of few have fewer words, and caps wider by much."""
    return min(words, 4 ** min(16, -(-dim // 2))), alpha / math.sqrt(dim), min(slack / math.sqrt(dim), max(0.08, 0.65 / dim - 0.02))


def _filters(kind: str, blocks: int, words: int, alpha: float, slack: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data = batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(data):
                by_size.setdefault(len(v) // np.dtype(kind).itemsize, []).append(i)
            for dim, places in by_size.items():
                own_words, own_alpha, own_slack = shape(dim, words, alpha, slack)
                if dim not in made:
                    made[dim] = (*codes(dim, blocks, own_words, seed), np.random.default_rng(seed + 1).standard_normal((dim, BITS)))
                rotation, code, planes = made[dim]
                for k in range(0, len(places), DECODED):
                    part = places[k : k + DECODED]
                    x = _unit([data[i] for i in part], kind)
                    row, name = decode(x, rotation, code, own_alpha, own_slack)
                    sketch = np.packbits(x @ planes >= 0, axis=1)
                    yield pa.record_batch({"filter": pa.array(name + (dim << NUMBER)), "node": pa.array(ids[np.array(part)[row]]), "sketch": pa.array([sketch[r].tobytes() for r in row], pa.binary())})

    return run


def _pack(kind: str):
    """Usable vectors as bytes; those of very large or small norm are scaled by a power of two, which changes no cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for v in batch.column(1).to_pylist():
                x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                    packed.append(None)
                    continue
                most = np.abs(x).max()
                if kind == "<f8" and not 1e-100 < most < 1e100:
                    x = np.ldexp(x, -np.frexp(most)[1])
                packed.append(x.astype(kind).tobytes())
            yield pa.record_batch({"vec_id": batch.column(0), "vector": pa.array(packed, pa.binary())})

    return run


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables that hold whole runs of rows of equal first `key` columns; many small runs together."""
    left = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if left is None else pa.concat_tables([left, table]).combine_chunks()
        last = int(_bounds(table, key)[-2])
        if last:
            yield table.slice(0, last)
        left = table.slice(last)
    if left is not None and left.num_rows:
        yield left


def _bounds(table: pa.Table, key: int) -> np.ndarray:
    """Where each run of rows of equal first `key` columns begins, and the end."""
    names = [table.column(c).to_numpy() for c in range(key)]
    return np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1, [table.num_rows]))


def _sketch_meet(threshold: float):
    """The entries (filter, i, j, own, node) that have another one near by sketch in their piece of work."""
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    most = BITS * p + 6 * math.sqrt(BITS * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            bounds = _bounds(table, 3)
            size = np.diff(bounds)
            bits = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint64).reshape(-1, BITS // 64)
            block, other, own = (table.column(c).to_numpy() for c in (1, 2, 3))
            live = np.zeros(table.num_rows, bool)
            last = np.repeat(bounds[1:], size)
            # pairs at a distance of 1, 2, ... rows within all runs at once
            rows = np.arange(table.num_rows)
            step = 1
            while len(rows := rows[rows + step < last[rows]]):
                to = rows + step
                near = np.bitwise_count(bits[rows] ^ bits[to]).sum(1) <= most
                near &= (block[rows] == other[rows]) | (own[rows] != own[to])
                live[rows[near]] = live[to[near]] = True
                step += 1
            if live.any():
                yield from table.select([0, 1, 2, 3, 4]).filter(pa.array(live)).combine_chunks().to_batches()

    return run


def _meet(threshold: float, kind: str):
    def met(rows: list[tuple]) -> tuple[list, list]:
        key, i, j = rows[0][:3]
        own = np.array([r[3] for r in rows])
        node, weight = [r[4] for r in rows], np.array([r[5] for r in rows], np.float64)
        x = _unit([r[6] for r in rows], kind)
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if i != j:
            near &= own[:, None] != own[None, :]
        if not near.any():
            return [], []
        # of the filters that a pair shares, only the smallest counts it
        earlier = [np.frombuffer(r[7], np.int64) for r in rows]
        earlier = [e[e < key] for e in earlier]
        names, index = np.unique(np.concatenate(earlier), return_inverse=True) if any(map(len, earlier)) else (np.zeros(0), np.zeros(0, int))
        places = np.repeat(np.arange(len(rows)), [len(e) for e in earlier])
        for k in range(0, len(names), NAMES):
            some = (index >= k) & (index < k + NAMES)
            inside = np.zeros((len(rows), NAMES), np.float32)
            inside[places[some], index[some] - k] = 1
            near &= inside @ inside.T == 0
        counts = near @ weight
        links, comp = [], np.arange(len(rows))
        for a in np.flatnonzero(near.any(1)):
            for b in np.flatnonzero(near[a] & (comp != comp[a])):
                if comp[a] != comp[b]:
                    links.append((node[a], node[b]))
                    comp[comp == comp[b]] = comp[a]
        return [(node[a], int(counts[a])) for a in np.flatnonzero(counts)], links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            counts, links = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    c, e = met(rows)
                    counts, links, rows = counts + c, links + e, []
                rows.append(row)
            yield out(counts, links)
        if rows:
            yield out(*met(rows))

    def out(counts, links):
        n, m = len(counts), len(links)
        columns = ([x for x, _ in counts] + [x for x, _ in links], [None] * n + [y for _, y in links], [c for _, c in counts] + [None] * m)
        return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "n"), columns, strict=True)})

    return run


def cap_filter_links(embeddings: DataFrame, threshold: float = 0.9, blocks: int = 2, words: int = 512, alpha: float = 4.0, slack: float = 0.5, seed: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of embeddings (vec_id long, embedding array of numbers).

    Two vectors link when they share a filter and their cosine, in double precision, is `threshold` or more. n_links
    counts the other vectors linked directly, component_id is the smallest vec_id reachable by links, kept marks it.
    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, nor do vectors of
    different dimensions. Copies of one vector always link. Rows that repeat a vec_id are one vector that links what any
    of them links. A null vec_id links with nothing. An empty table gives an empty result. Labels and other columns are
    ignored. alpha and slack are over the square root of the dimension.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    kind = "<f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, T.FloatType) else "<f8"
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    packed = cut(plain.mapInArrow(_pack(kind), "vec_id long, vector binary"))
    named = packed.where("vec_id is not null and vector is not null").distinct()
    nodes = cut(named.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")))
    filters = cut(nodes.select("node", "vector").mapInArrow(_filters(kind, blocks, words, alpha, slack, seed), "filter long, node long, sketch binary"))
    sizes = filters.groupBy("filter").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("size")).where("size > 1").drop("size")
    shared = joined(filters, sizes, ["filter"], "inner").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = shared.select("filter", "own", "node", "sketch", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("filter", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "sketch")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 16)
    piece = ["filter", "i", "j"]
    together = lambda df: df.repartition(tasks, *piece).sortWithinPartitions(*piece)
    live = cut(together(dealt).mapInArrow(_sketch_meet(threshold), "filter long, i int, j int, own int, node long"))
    lists = live.groupBy("node").agg(F.array_sort(F.collect_set("filter")).alias("list"))
    full = nodes.join(lists, "node").select("node", "weight", "vector", "list").mapInArrow(_lists, "node long, weight long, vector binary, list binary")
    rows = together(live.join(full, "node").select(*piece, "own", "node", "weight", "vector", "list"))
    found = cut(rows.mapInArrow(_meet(threshold, kind), "a long, b long, n long"))
    counts = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("found"))
    copies = named.join(nodes, "vector").select("vec_id", "node", "weight")
    same_id = copies.groupBy("vec_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")
    labels = connected_components(found.where("b is not null").select("a", "b").union(same_id))
    per_id = copies.join(counts, "node", "left").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    per_id = per_id.groupBy("vec_id").agg(F.sum(F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.min(F.coalesce("component", "node")).alias("component"))
    out = packed.select("vec_id").join(per_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.array(x, np.int64).tobytes() for x in batch.column(3).to_pylist()]
        yield pa.record_batch({"node": batch.column(0), "weight": batch.column(1), "vector": batch.column(2), "list": pa.array(lists, pa.binary())})
