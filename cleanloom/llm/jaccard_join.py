"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles. Under any one global order of shingles, two sets that overlap in t
shingles share at least e of them among their first n - t + e ones. Shingles are ordered by how frequent a corpus-wide
count sketch says they are, rarest first, and fall into classes: rare ones are indexed by themselves, frequent ones in
pairs from the same of c classes. As the prefix is longer by c, at least c + 1 of its shingles are shared, hence one rare
shingle or, by the pigeonhole principle, a pair from one class. Candidates are then verified on the whole sets, exactly.

Exact copies of a set are collapsed before the index is built. Within an index entry no product of all members is made:
each member is verified against a few centres, what links is merged, and only members of entries that still hold several
components go on: in pairs where an entry is small, else block by block, so that a large group is never a table of its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanloom.llm import _hashing
from cleanloom.llm._common import bounded_batches, cut, input_bytes, joined, removed, shipped, written
from cleanloom.llm._components import connected_components
from cleanloom.llm._hashing import mix, packed, shingle_sets, slices, unpacked

shipped(__name__)
shipped(_hashing.__name__)

#: Least and most cells of the count sketch, and most cells in a stripe, which one task adds up at a time.
CELLS, STRIPE = (1 << 18, 1 << 30), 1 << 20
#: Shingles that a worker gathers before it hands on their counts.
GATHERED = 1 << 19
#: Cells of frequent shingles that are broadcast at most; if there are more, the least frequent of them count as rare.
FREQUENT = 1 << 21
#: Centres of an entry that its members are verified against first.
CENTRES = 4
#: Entries of more members are not paired row by row: their members meet in blocks of BLOCK documents, fewer if these are long.
COLD, BLOCK, BLOCK_SHINGLES = 32, 512, 1 << 18


def _pattern(k: int) -> int:
    """Chooses an entry's k-th centre: the member with the least id XOR pattern."""
    return (k * 0x9E3779B97F4A7C15 >> 1) & (1 << 63) - 1


def sketch_cells(input_bytes: int) -> int:
    """A power of two near a thirty-second of the input's bytes, so that a cell's chance load stays small, within CELLS."""
    return min(max(1 << max(0, (input_bytes // 32).bit_length()), CELLS[0]), CELLS[1])


def _members(width: int, cells: int):
    """One row for each text, and between them the counts of the shingles seen since, by stripes of sketch cells."""
    stripe = min(STRIPE, cells // 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for first, part in slices(batch.column(1)):
                sets = shingle_sets(part, width)
                waiting += [(s & np.uint64(cells - 1)).astype(np.uint32) for s in sets]
                size += sum(map(len, sets))
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield _row(batch.column(0)[first : first + len(part)], [len(s) for s in sets], digest, None, None, None)
                if size > GATHERED:
                    yield _counted(waiting, stripe)
                    waiting, size = [], 0
        if size:
            yield _counted(waiting, stripe)

    return run


def _counted(cells: list[np.ndarray], stripe: int) -> pa.RecordBatch:
    """A row for each stripe that has some of the cells named: its cells and how often each was named."""
    at, n = np.unique(np.concatenate(cells), return_counts=True)
    number, first = np.unique(at // np.uint32(stripe), return_index=True)
    parts = [slice(a, b) for a, b in zip(first, [*first[1:], len(at)], strict=True)]
    return _row(None, None, None, number, [packed(at[p] % np.uint32(stripe), True) for p in parts], [packed(n[p]) for p in parts])


def _row(doc_id, size, digest, stripe, cells, counts) -> pa.RecordBatch:
    rows = len(doc_id) if doc_id is not None else len(stripe)
    kinds = {"doc_id": pa.int64(), "n_shingles": pa.int64(), "digest": pa.binary(), "stripe": pa.int32(), "cells": pa.binary(), "counts": pa.binary()}
    given = zip(kinds.items(), (doc_id, size, digest, stripe, cells, counts), strict=True)
    return pa.record_batch({c: pa.nulls(rows, t) if v is None else pa.array(v, t) for (c, t), v in given})


def _add(stripe: int, rare: float):
    """The frequent cells of each stripe by level; rows of a stripe follow one another, so that one stripe is held at a time."""

    def levels(k: int, total: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(total > rare)
        level = 1 + np.log2(total[at] / rare).astype(np.int32)
        found = {x: at[level == x] + k * stripe for x in np.unique(level)}
        return pa.record_batch({"level": pa.array(list(found), pa.int32()), "n": pa.array([len(v) for v in found.values()], pa.int64()), "cells": pa.array([packed(v, True) for v in found.values()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(stripe, np.int64)
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        yield levels(now, total)
                    now, total[:] = k, 0
                total[unpacked(cells, True).astype(np.int64)] += unpacked(counts).astype(np.int64)
        if now is not None:
            yield levels(now, total)

    return run


class Frequency:
    """The level of each shingle: 0 if rare, else one more for each doubling of its cell's count."""

    def __init__(self, cells: int, found: dict[int, np.ndarray]):
        self.cells = cells
        at = np.concatenate([np.zeros(0, np.uint32), *(v.astype(np.uint32) for v in found.values())])
        level = np.concatenate([np.zeros(0, np.uint8), *(np.full(len(v), k, np.uint8) for k, v in found.items())])
        order = np.argsort(at)
        self.at, self.level = at[order], level[order]

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        cell = (shingles & np.uint64(self.cells - 1)).astype(np.uint32)
        out = np.zeros(len(cell), np.uint8)
        if len(self.at):
            some = np.flatnonzero(self.maybe[cell & np.uint32(len(self.maybe) - 1)])
            place = np.minimum(np.searchsorted(self.at, cell[some]), len(self.at) - 1)
            out[some] = np.where(self.at[place] == cell[some], self.level[place], 0)
        return out

    def ready(self) -> Frequency:
        """With a table that rules most cells out; a worker makes it for itself."""
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.at & np.uint32((1 << 22) - 1)] = True
        return self


def frequencies(counts: DataFrame, cells: int, shingles: int) -> Frequency:
    """The levels from the counts (stripe, cells, counts) of all shingles of all texts.

    At most FREQUENT cells go to the driver: how many each level has is known before any is fetched.
    """
    stripe, mean = min(STRIPE, cells // 16), shingles / cells
    rare = mean + 3 * math.sqrt(mean) + 3
    tasks = max(16, min(cells // stripe, 8 * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    summed = counts.repartition(tasks, "stripe").sortWithinPartitions("stripe").mapInArrow(_add(stripe, rare), "level int, n long, cells binary")
    summed = cut(summed)
    least, total = 1, 0
    for r in summed.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.col("level").desc()).collect():  # some forty rows
        total += r.n
        if total > FREQUENT:
            least = r.level + 1
            break
    found: dict[int, list] = {}
    for r in summed.where(F.col("level") >= least).select("level", "cells").toLocalIterator():
        found.setdefault(r.level, []).append(unpacked(bytes(r.cells), True))
    return Frequency(cells, {k: np.concatenate(v) for k, v in found.items()})


def _classes(n: int, num: int, den: int) -> int:
    """How many classes the frequent shingles of a set of this size fall into: a power of two, about eight prefix shingles each."""
    return 1 << max(0, (n * (den - num) // (8 * den)).bit_length() - 1)


def signatures(values: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The index entries of a set: rare prefix shingles, and pairs of frequent ones from the same class.

    The number of classes depends on the size, so a set takes part under each number that a partner's size could give.
    """
    n = len(values)
    least = -(-n * num // den)
    if least < 2:
        return values
    order = np.lexsort((values, level))
    values, level = values[order], level[order]
    out = []
    for c in {_classes(n, num, den), _classes(n * den // num, num, den)}:
        if least < c + 1:
            return np.unique(values)
        prefix = n - least + c + 1
        own, rare = values[:prefix], level[:prefix] == 0
        out.append(own[rare])
        common = np.sort(own[~rare])
        kind = (common >> np.uint64(40)) % np.uint64(c)
        for k in range(c) if len(common) > 1 else ():
            x = common[kind == k]
            if len(x) > 1:
                i, j = np.triu_indices(len(x), 1)
                out.append(mix(mix(x[i] + np.uint64(2 * c + 1)) ^ x[j]))
    return np.unique(np.concatenate(out))


def _index(width: int, num: int, den: int, frequency: Frequency):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = frequency.ready()
        for batch in batches:
            for first, part in slices(batch.column(1)):
                sets = shingle_sets(part, width)
                ids = batch.column(0)[first : first + len(part)].to_numpy(zero_copy_only=False)
                level = np.split(levels(np.concatenate(sets)), np.cumsum([len(s) for s in sets])[:-1])
                found = [signatures(s, x, num, den) for s, x in zip(sets, level, strict=True)]
                size = [len(x) for x in found]
                yield pa.record_batch({"sig": pa.array(np.concatenate(found).view(np.int64)), "node": pa.array(np.repeat(ids, size)), "n": pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), size))})

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(part, width)]
                yield pa.record_batch({"node": batch.column(0)[first : first + len(part)], "members": pa.array(sets, pa.binary())})

    return run


def _parts(width: int, sixteenths: int):
    """A hash-chosen part of each set, in 16 bits a shingle; n is the size of the whole. Chance matches only let pairs pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                sets = shingle_sets(part, width)
                some = [s[(s >> np.uint64(56)) % np.uint64(16) < sixteenths].astype("<u2").tobytes() for s in sets]
                yield pa.record_batch({"node": batch.column(0)[first : first + len(part)], "n": pa.array([len(s) for s in sets], pa.int32()), "part": pa.array(some, pa.binary())})

    return run


def _possible(num: int, den: int):
    """Pairs that could be similar enough if all shingles outside the parts were shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
                most = int(np.isin(x, y).sum()) + min(n - len(x), m - len(y))
                keep.append(den * most >= num * (n + m - most))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * shared >= num * (len(both) - shared))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(keep, pa.bool_()))

    return run


def _both(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of rows (node, ...) for either end, as x_... and y_..."""
    for end, mark in (("a", "x"), ("b", "y")):
        pairs = pairs.join(rows.select(*(F.col(c).alias(end if c == "node" else f"{mark}_{c}") for c in rows.columns)), end)
    return pairs


def _links(pairs: DataFrame, docs: DataFrame, parts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked. The parts rule most pairs out before whole sets are read."""
    maybe = _both(pairs, parts).select("a", "b", "x_part", "y_part", "x_n", "y_n").mapInArrow(_possible(num, den), "a long, b long")
    maybe = cut(maybe)
    wanted = maybe.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = joined(docs, wanted, ["doc_id"], "left_semi").mapInArrow(_sets(width), "node long, members binary")
    return _both(maybe, sets).select("a", "b", "x_members", "y_members").mapInArrow(_verify(num, den), "a long, b long")


def _meet(num: int, den: int):
    """Links between different components within each run of rows of the same (lead, i, j)."""

    def met(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1:3]
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        own = np.array([r[3] for r in rows])
        node = [r[4] for r in rows]
        comp = np.unique([r[5] for r in rows], return_inverse=True)[1]
        size = np.array([len(s) for s in sets])
        values, ids = np.unique(np.concatenate(sets), return_inverse=True)
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        seen, found = np.zeros(len(values), np.int32), []
        for k in range(len(rows)):
            others = comp != comp[k]
            if i != j:
                others &= own != own[k]
            others[:k] &= False
            others &= (np.minimum(size, size[k]) * den >= np.maximum(size, size[k]) * num)
            if not others.any():
                continue
            mine = ids[first[k] : first[k] + size[k]]
            seen[mine] = 1
            shared = np.add.reduceat(seen[ids], first)
            seen[mine] = 0
            for m in np.flatnonzero(others & (den * shared >= num * (size + size[k] - shared))):
                if comp[m] != comp[k]:
                    found.append((node[k], node[m]))
                    comp[comp == comp[m]] = comp[k]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    found += met(rows)
                    rows = []
                rows.append(row)
            yield _edges(found)
        if rows:
            yield _edges(met(rows))

    return run


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _block_links(hot: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links among the members (node, n, comp) of each group (lead), without a row for each pair.

    A group is dealt into blocks of about BLOCK documents, or BLOCK_SHINGLES shingles if that is less; each pair of
    blocks is a piece of work of bounded size.
    """
    sizes = hot.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = hot.join(sizes, "lead").withColumn("own", own)
    dealt = dealt.select("lead", "own", "node", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp")
    wanted = hot.select(F.col("node").alias("doc_id")).distinct()
    sets = joined(docs, wanted, ["doc_id"], "left_semi").mapInArrow(_sets(width), "node long, members binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)
    rows = dealt.join(sets, "node").select("lead", "i", "j", "own", "node", "comp", "members").repartition(tasks, "lead", "i", "j")
    return rows.sortWithinPartitions("lead", "i", "j").mapInArrow(_meet(num, den), "a long, b long")


def _with_component(index: DataFrame, labels: DataFrame) -> DataFrame:
    named = index.drop("comp").join(labels.withColumnRenamed("id", "node"), "node", "left")
    return named.select("sig", "node", "n", F.coalesce("component", "node").alias("comp"))


def _by_length(index: DataFrame, num: int, den: int) -> DataFrame:
    """Entries split by set size: sizes that the similarity allows together lie in one band or in two that follow."""
    width = max(1.001 * math.log(den / num), 1e-6)
    band = F.floor(F.log("n") / F.lit(width))
    return index.select(F.explode(F.array(band, band + 1)).alias("band"), "*").withColumn("sig", F.xxhash64("sig", "band")).drop("band")


def _mixed(index: DataFrame) -> DataFrame:
    """The entries that hold more than one component."""
    several = index.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    return index.join(several, "sig")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id long, text string; other columns are ignored).

    Two documents link when den * intersection >= num * union of their sets of distinct shingles of `width` words, A-Z in
    lower case. A text of fewer words is one shingle; a text without words, or null, has none and links with nothing.
    component_id is the smallest doc_id reachable by links. Rows with the same doc_id are one document that links what
    any of them links. A row whose doc_id is null links with nothing, and its component_id is null. An empty table gives
    an empty result.
    """
    if not 0 < num <= den:
        raise ValueError("the similarity is a fraction num / den in (0, 1]")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    bounded_batches(spark)
    cells = sketch_cells(input_bytes(docs))
    first = cut(docs.mapInArrow(_members(width, cells), "doc_id long, n_shingles long, digest binary, stripe int, cells binary, counts binary"))
    members = first.where("n_shingles is not null").select("doc_id", "n_shingles", "digest")
    shingles = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    levels = frequencies(first.where("stripe is not null").select("stripe", "cells", "counts"), cells, shingles)
    named = members.where("doc_id is not null and digest is not null")
    copies = cut(named.groupBy("digest").agg(F.min("doc_id").alias("node")))
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    extra = named.select("doc_id").join(copies.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").distinct()
    texts = joined(docs.where("doc_id is not null"), extra, ["doc_id"], "left_anti")
    whole, path = written(texts.mapInArrow(_index(width, num, den, levels), "sig long, node long, n int"), "jaccard-index")
    shared = whole.join(whole.groupBy("sig").count().where("count > 1").select("sig"), "sig")
    index = cut(_by_length(shared, num, den).withColumn("comp", F.col("node")))
    removed(spark, path)
    index = cut(_mixed(index))
    sixteenths = min(16, math.ceil(36 * (den - num) / (den + num)))
    parts, parts_path = written(texts.mapInArrow(_parts(width, sixteenths), "node long, n int, part binary"), "jaccard-parts")
    same_id = named.join(several, "doc_id", "left_semi").join(copies, "digest")
    links = cut(same_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    patterns = [F.lit(_pattern(k)) for k in range(CENTRES)]
    least = index.groupBy("sig").agg(*(F.min(F.col("node").bitwiseXOR(p)).alias(f"c{k}") for k, p in enumerate(patterns)))
    centre = F.explode(F.array(*(F.col(f"c{k}").bitwiseXOR(p) for k, p in enumerate(patterns))))
    tested = index.join(least, "sig").select("node", centre.alias("centre")).where("node <> centre")
    tested = cut(tested.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())
    links = cut(links.union(_links(tested, docs, parts, width, num, den)))
    index = cut(_mixed(_with_component(index, connected_components(links))))
    counts = index.groupBy("sig").agg(F.count("*").alias("size"), F.min("node").alias("lead"))
    cold = index.join(counts.where(F.col("size") <= COLD).select("sig"), "sig")
    x, y = cold.alias("x"), cold.alias("y")
    rest = x.join(y, F.expr(f"x.sig = y.sig and x.comp < y.comp and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num}"))
    rest = rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    rest = cut(rest.join(tested, ["a", "b"], "left_anti"))
    hot = index.join(counts.where(F.col("size") > COLD), "sig").select("lead", "node", "n", "comp").distinct()
    links = links.union(_links(rest, docs, parts, width, num, den)).union(_block_links(cut(hot), docs, width, num, den))
    labels = connected_components(links)
    removed(spark, parts_path)
    out = members.join(copies, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node"))
    labels = labels.select(F.col("id").alias("node"), "component")
    return out.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def drop_near_copies(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs of which one document of each component stays: that with the smallest doc_id.

    All columns are kept. Texts without words and rows without a doc_id always stay; rows that repeat a doc_id stay together.
    """
    found = jaccard_components(docs, width, num, den)
    extra = found.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)
