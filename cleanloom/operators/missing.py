"""Imputation: thirteen strategies, chosen for each column from one statistics job."""

from __future__ import annotations

import sys
import tempfile
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.errors import PySparkTypeError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from cleanloom.core import ROW_ID, data_columns, is_nested, is_number, is_text, is_time, percent, quoted, replaced, resolve_columns, step, stored, with_row_id
from cleanloom.functions.stats import distinct_counts, finite, one_row, quantiles, sample_skewness

cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRATEGIES = ("auto", "drop_rows", "drop_columns", "mean", "median", "mode", "constant", "ffill", "bfill", "interpolate", "knn", "iterative", "leave")
#: Strategies that follow the rows' order.
ALONG = ("ffill", "bfill", "interpolate")
#: Rows of a block of donors, and of rows that look for neighbours among them, on average.
DONOR_BLOCK, RECEIVER_BLOCK = 10_000, 2_000
#: Bytes of rows that wait in memory for their next known value; further ones wait in a temporary file.
WAITING_BYTES = 32 << 20
#: What is interpolated between numbers up to this one is finite.
SAFE = 1e290


def missing(c: str, kind: T.DataType) -> Column:
    e = quoted(c)
    return e.isNull() | F.isnan(e) if isinstance(kind, (T.FloatType, T.DoubleType)) else e.isNull()


def choose_strategies(df: DataFrame, columns: list[str], counts: dict[tuple, int]) -> tuple[dict[str, str], dict[str, float]]:
    """The automatic choice for each column, from a few jobs over all of them, and the medians that were found on the way.

    counts: ("rows",) and (column,), its gaps. The median of a column with infinities is not among those found.
    """
    kinds, rows, out = {f.name: f.dataType for f in df.schema}, counts["rows",], {}
    live = [c for c in columns if counts[c,] < rows and counts[c,] / rows < 0.60]
    value = {c: finite(quoted(c)) for c in live if is_number(kinds[c])}
    got = one_row(df, {(c, k): f(v) for c, v in value.items() for k, f in (("skew", sample_skewness), ("least", F.min), ("most", F.max))})
    unique = distinct_counts(df, {c: quoted(c) for c in live if is_text(kinds[c])})
    at = quantiles(df, value, (0.25, 0.5, 0.75))
    spread = {c: 1.5 * (at[c, 0.75] - at[c, 0.25]) for c in value if at[c, "n"]}
    far = {c: got[c, "least"] < at[c, 0.25] - x or got[c, "most"] > at[c, 0.75] + x for c, x in spread.items()}
    medians = {c: at[c, 0.5] for c in spread if at[c, "n"] == rows - counts[c,]}
    for c in columns:
        if c not in live:
            out[c] = "drop_columns"
        elif isinstance(kinds[c], T.BooleanType):
            out[c] = "mode"
        elif is_number(kinds[c]):
            if c not in far:
                out[c] = "drop_columns"
            else:
                out[c] = "mean" if not far[c] and abs(got[c, "skew"] or 0.0) <= 0.5 else "median"
        elif is_time(kinds[c]):
            out[c] = "ffill"
        elif is_text(kinds[c]):
            out[c] = "mode" if unique[c] <= max(20, 0.05 * rows) else "constant"
        else:
            out[c] = "constant"
    return out, medians


def most_frequent(df: DataFrame, values: dict[str, Column]) -> dict[tuple, object]:
    """(column,): the most frequent value, the least of several. Values are counted before the shuffle and never held together."""
    out = {}
    for c, e in values.items():
        row = df.select(e.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "v").first()
        out[c,] = row and row.v
    return out


def _known(df: DataFrame, c: str) -> Column:
    """The value of c, null where it is missing."""
    return F.when(~missing(c, df.schema[c].dataType), quoted(c))


def _in_arrow(kind: T.DataType) -> bool:
    try:
        return to_arrow_type(kind) is not None
    except PySparkTypeError:
        return False


def _runs(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(part, rows): the batches, cut where the part changes; `at` is the place of the row ids among the columns."""
    for batch in batches:
        parts = batch.column(at).to_numpy() >> 33
        for a, b in pairwise([0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]):
            if a < b:
                yield int(parts[a]), batch.slice(a, b - a)


def _carried_on(df: DataFrame, how: dict[str, str]) -> dict[str, Column]:
    """The known values of the columns to fill; of types that Arrow lacks, the ids of their rows instead."""
    known = {c: _known(df, c).cast("double") if s == "interpolate" else _known(df, c) for c, s in how.items()}
    return {c: v if _in_arrow(df.schema[c].dataType) else F.when(v.isNotNull(), F.col(ROW_ID)) for c, v in known.items()}


def part_ends(df: DataFrame, how: dict[str, str], counts: dict[tuple, Column] | None = None) -> tuple[pa.Table, dict[tuple, int]]:
    """For each part of the row ids: n, its rows, and the ids that it begins and ends with (low, high); by column to fill the ids
    (a, b) of the first and last row where it is known, whether numbers between are finite (safe), and the values there (v, w) of
    numbers and truth values. And sums of counts over all parts. One aggregation by hash, a row for each part goes to the driver."""
    known, counts = _carried_on(df, how), counts or {}
    kinds = {c: t.dataType for c, t in zip(known, df.select(*known.values()).schema, strict=True)}
    each, types = {"n": F.count("*"), "low": F.min(ROW_ID), "high": F.max(ROW_ID)}, {}
    for c, v in known.items():
        at = F.when(v.isNotNull(), F.col(ROW_ID))
        each |= {f"a {c}": F.min(at), f"b {c}": F.max(at)}
        if is_number(kinds[c]) or isinstance(kinds[c], T.BooleanType):
            each |= {f"v {c}": F.min_by(v, at), f"w {c}": F.max_by(v, at)}
            types |= dict.fromkeys((f"v {c}", f"w {c}"), to_arrow_type(kinds[c]))
        if how[c] == "interpolate":
            each[f"safe {c}"] = F.coalesce(F.max(F.abs(v)) <= SAFE, F.lit(True))
            types[f"safe {c}"] = pa.bool_()
    names = ["part", *each]
    parts = df.groupBy(F.shiftright(F.col(ROW_ID), 33).alias("e0")).agg(*(e.alias(f"e{k}") for k, e in enumerate(each.values(), 1)), *(e.alias(f"s{k}") for k, e in enumerate(counts.values())))
    whole = F.collect_list(F.struct(*(f"e{k}" for k in range(len(names))))).alias("parts")
    got = parts.agg(whole, *(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(counts)))).first()
    ends = pa.table([pa.array([r[k] for r in got.parts], types.get(name, pa.int64())) for k, name in enumerate(names)], names=names)
    return ends, {name: got[f"s{k}"] or 0 for k, name in enumerate(counts)}


def _values_and_places(named: DataFrame, ends: pa.Table, how: dict[str, str]) -> pa.Table:
    """ends with the values (v, w) that are not yet there, and the places (i, j) of those rows in their part.

    Values that part_ends leaves out are looked up by the ids of their rows. Where ids have gaps, places that interpolation needs are counted.
    """

    def asked(columns: list[str]) -> DataFrame:
        ids = np.unique(np.concatenate([ends[f"{e} {c}"].drop_null().to_numpy() for c in columns for e in "ab"]).astype(np.int64))
        return F.broadcast(named.sparkSession.createDataFrame(pa.table({"__of": ids, "__part": ids >> 33})))

    wide, straight = [c for c in how if f"v {c}" not in ends.column_names], [c for c, s in how.items() if s == "interpolate"]
    if wide:
        rows = named.select(ROW_ID, *(quoted(c).alias(f"c{k}") for k, c in enumerate(wide))).join(asked(wide), F.col(ROW_ID) == F.col("__of"), "left_semi").toArrow()
        for k, c in enumerate(wide):
            for e, v in (("a", "v"), ("b", "w")):
                ends = ends.append_column(f"{v} {c}", rows[f"c{k}"].combine_chunks().take(pc.index_in(ends[f"{e} {c}"].combine_chunks(), rows[ROW_ID])))
    place = lambda ids: pc.subtract(ids, ends["low"])
    if straight and not pc.all(pc.equal(pc.add(place(ends["high"]), 1), ends["n"])).as_py():
        before = (F.shiftright(F.col(ROW_ID), 33) == F.col("__part")) & (F.col(ROW_ID) < F.col("__of"))
        found = named.select(ROW_ID).join(asked(straight), before).groupBy("__of").agg(F.count("*").alias("n")).toArrow()
        n = dict(zip(found["__of"].to_pylist(), found["n"].to_pylist(), strict=True))
        place = lambda ids: pa.array([None if x is None else n.get(x, 0) for x in ids.to_pylist()], pa.int64())
    for c in how:
        for e, i in (("a", "i"), ("b", "j")):
            ends = ends.append_column(f"{i} {c}", place(ends[f"{e} {c}"]))
    return ends


class _Carried:
    """What the rows of a part can take from outside, by the ends of all parts: (value, place) of the nearest known values."""

    def __init__(self, ends: pa.Table, columns: list[str]):
        ends = ends.sort_by("part")
        n = ends["n"].to_numpy()
        self.at = {p: j for j, p in enumerate(ends["part"].to_pylist())}
        self.start, self.columns = np.cumsum(n) - n, []
        for c in columns:
            known, spots = ends[f"i {c}"].is_valid().to_numpy(), np.arange(len(n))
            before = np.r_[-1, np.maximum.accumulate(np.where(known, spots, -1))]
            after = np.r_[np.minimum.accumulate(np.where(known, spots, len(n))[::-1])[::-1], len(n)]
            values = [ends[f"{e} {c}"].combine_chunks() for e in ("v", "w")]
            places = [ends[f"{e} {c}"].fill_null(0).to_numpy() + self.start for e in ("i", "j")]
            self.columns.append((values, places, before, after))

    def _end(self, k: int, which: int, spot: int) -> tuple[pa.Array, int]:
        values, places, *_ = self.columns[k]
        return (values[which].slice(spot, 1), int(places[which][spot])) if 0 <= spot < len(self.start) else (pa.nulls(1, values[which].type), 0)

    def before(self, part: int, k: int) -> tuple[pa.Array, int]:
        return self._end(k, 1, self.columns[k][2][self.at[part]])

    def after(self, part: int, k: int, itself: bool = False) -> tuple[pa.Array, int]:
        """The first known value beyond the part, or from its own first row on."""
        return self._end(k, 0, self.columns[k][3][self.at[part] + (not itself)])


def _taken(how: str, v: pa.Array, start: int, before: tuple[pa.Array, int], after: tuple[pa.Array, int]) -> pa.Array:
    """v filled; its rows begin at the place `start`, and before and after are the nearest known values outside."""
    n, known = len(v), v.is_valid().to_numpy(zero_copy_only=False)
    spots = np.arange(1, n + 1)
    last = np.maximum.accumulate(np.where(known, spots, 0))
    coming = np.minimum.accumulate(np.where(known, spots, n + 1)[::-1])[::-1]
    values = pa.concat_arrays([before[0].cast(v.type), v, after[0].cast(v.type)])
    none_before, none_after = (last == 0) & (not before[0][0].is_valid), (coming == n + 1) & (not after[0][0].is_valid)
    if how != "interpolate":
        return values.take(pa.array(np.where(none_before, coming, last) if how == "ffill" else np.where(none_after, last, coming)))
    numbers, places = values.fill_null(0.0).to_numpy(), np.r_[before[1], start + spots - 1, after[1]]
    low, high = numbers[last], numbers[coming]
    with np.errstate(all="ignore"):
        between = low + (high - low) * (places[spots] - places[last]) / (places[coming] - places[last])
    got = np.where(known, numbers[spots], np.where(none_after, low, np.where(none_before, high, between)))
    return pa.array(got, mask=none_before & none_after, from_pandas=False)


def _filler(how: list[tuple[int, str]], at: int, carried: _Carried):
    """Fills (column, strategy) along the rows of each part. Rows whose next known value is yet to come wait for it."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: deque[list] = deque()
        held, file = 0, None

        def done() -> pa.RecordBatch:
            nonlocal held
            rows, start, before, after = waiting.popleft()
            if isinstance(rows, int):
                file.seek(rows)
                rows = pa.ipc.open_stream(file).read_next_batch()
            else:
                held -= rows.nbytes
            columns = rows.columns
            for k, (c, s) in enumerate(how):
                columns[c] = _taken(s, columns[c], start, before[k], after[k])
            return pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

        def come(k: int, found: tuple[pa.Array, int]) -> None:
            for entry in reversed(waiting):
                if entry[3][k] is not None:
                    break
                entry[3][k] = found

        def rest() -> Iterator[pa.RecordBatch]:
            for k in range(len(how) if waiting else 0):
                come(k, carried.after(part, k))
            while waiting:
                yield done()

        part, place, before = None, 0, []
        for p, rows in _runs(batches, at):
            if p != part:
                yield from rest()
                part, place = p, int(carried.start[carried.at[p]])
                before = [carried.before(p, k) for k in range(len(how))]
            entry = [rows, place, list(before), [None] * len(how)]
            for k, (c, s) in enumerate(how):
                v = rows.column(c)
                spots = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
                if s == "ffill":  # what comes next matters before the first known value of all only
                    entry[3][k] = carried.after(p, k, itself=True)
                elif len(spots):
                    come(k, (v.take([spots[0]]), place + int(spots[0])))
                    if spots[-1] == len(v) - 1:
                        entry[3][k] = (pa.nulls(1, v.type), 0)
                if len(spots):
                    before[k] = (v.take([spots[-1]]), place + int(spots[-1]))
            place += rows.num_rows
            waiting.append(entry)
            held += rows.nbytes
            while waiting and all(x is not None for x in waiting[0][3]):
                yield done()
            if waiting and held > WAITING_BYTES:
                file = file or tempfile.TemporaryFile()
                held -= rows.nbytes
                entry[0] = file.seek(0, 2)
                with pa.ipc.new_stream(file, rows.schema) as out:
                    out.write_batch(rows)
        yield from rest()
        if file:
            file.close()

    return fill


def _filled_in_groups(df: DataFrame, how: dict[str, str], partition_by: list[str]) -> DataFrame:
    """Each group is filled by itself: all columns in one pass up the rows and one down. Both frames begin where the pass does, as
    one that ends with the last row would be gone through again for each row."""
    groups = [quoted(p) for p in partition_by]
    up = Window.partitionBy(*groups).orderBy(ROW_ID)
    down = Window.partitionBy(*groups).orderBy(F.desc(ROW_ID))
    named = df.withColumn("__place", F.row_number().over(up))
    named = named.withColumns({f"__known{k}": F.when(_known(df, c).isNotNull(), F.struct(quoted(c).alias("v"), F.col("__place").alias("i"))) for k, c in enumerate(how)})
    nearest = lambda k, w: F.last(f"__known{k}", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    named = named.withColumns({f"__p{k}": nearest(k, up) for k in range(len(how))} | {f"__n{k}": nearest(k, down) for k in range(len(how))})
    new = {}
    for k, (c, s) in enumerate(how.items()):
        p, n = F.col(f"__p{k}"), F.col(f"__n{k}")
        if s == "ffill":
            new[c] = F.coalesce(p["v"], n["v"])
        elif s == "bfill":
            new[c] = F.coalesce(n["v"], p["v"])
        else:
            low, high = p["v"].cast("double"), n["v"].cast("double")
            between = low + (high - low) * (F.col("__place") - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0))
            new[c] = F.coalesce(_known(df, c).cast("double"), between, low, high)
    return replaced(named, new).select(*(quoted(x) for x in df.columns))


def ordered_fill(df: DataFrame, how: dict[str, str], partition_by: list[str], in_order: bool = False, ends: pa.Table | None = None) -> tuple[DataFrame, dict[str, int]]:
    """df with columns filled along the rows' order: ffill, bfill (each falls back on the other at its end) or interpolate; and the
    gaps that are left in them, where that is known without another pass.

    With partition_by each group is filled by itself. Without, each part of the row ids is, and takes from other parts what lies
    beyond its ends, so that no task has all rows: an aggregation finds the ends of each part, of which one row for each part goes
    to the driver, a pass over the rows fills. in_order says that each partition holds one part in its order; else rows are sorted
    first. ends: of the same rows, where part_ends has found them already.
    """
    if partition_by:
        return _filled_in_groups(df, how, partition_by), {}
    odd = [f.name for f in df.schema if not _in_arrow(f.dataType)]  # their rows' ids go through the passes instead of them
    named = replaced(df, {c: F.col(ROW_ID) for c in odd} | _carried_on(df, how))
    ends = _values_and_places(named, part_ends(df, how)[0] if ends is None else ends, how)
    rows = sum(ends["n"].to_pylist())
    left = {}
    for c, s in how.items():
        if ends[f"a {c}"].null_count == len(ends):
            left[c] = rows
        elif s != "interpolate" or all(ends[f"safe {c}"].to_pylist()):
            left[c] = 0
    if not in_order:
        named = named.repartition(F.shiftright(F.col(ROW_ID), 33)).sortWithinPartitions(ROW_ID)
    places, plain = {c: j for j, c in enumerate(df.columns)}, named.toDF(*(f"c{j}" for j in range(len(df.columns))))
    fill = _filler([(places[c], s) for c, s in how.items()], places[ROW_ID], _Carried(ends, list(how)))
    out = plain.mapInArrow(fill, plain.schema).toDF(*df.columns)
    for c in odd:
        values = df.select(F.col(ROW_ID).alias("__of"), quoted(c).alias("__value"))
        out = replaced(out.join(values, quoted(c) == F.col("__of"), "left"), {c: F.col("__value")}).drop("__of", "__value")
    return out, left


def _nearest(k: int, n_features: int, at: int):
    """The k nearest donors of each receiver within a pair of blocks, by distance, then by row id."""
    row_id = ROW_ID

    def search(receivers: pa.Table, donors: pa.Table) -> pa.Table:
        points = lambda t: np.stack([t[f"f{i}"].to_numpy().astype(np.float64) for i in range(n_features)])
        r_ids, d_ids = receivers[row_id].to_numpy(), donors[row_id].to_numpy()
        order = np.argsort(d_ids)
        r, d, d_ids = points(receivers), points(donors)[:, order], d_ids[order]
        known = ~np.isnan(d)
        out: list[list] = [[], [], [], []]
        for j in range(len(r_ids)):
            shared, squares = np.zeros(len(d_ids)), np.zeros(len(d_ids))
            for i in np.flatnonzero(~np.isnan(r[:, j])):
                with np.errstate(invalid="ignore", over="ignore"):
                    squares += np.where(known[i], (r[i, j] - d[i]) ** 2, 0.0)
                shared += known[i]
            near = np.flatnonzero((shared > 0) & (d_ids != r_ids[j]))
            distance = np.sqrt(squares[near] * n_features / shared[near])
            if len(near) > k:
                bound = np.partition(distance, k - 1)[k - 1]
                if not np.isnan(bound):
                    near, distance = near[distance <= bound], distance[distance <= bound]
            first = np.argsort(distance, kind="stable")[:k]
            for column, values in zip(out, (np.full(len(first), r_ids[j]), d_ids[near[first]], distance[first], d[at, near[first]]), strict=True):
                column.append(values)
        kinds = (np.int64, np.int64, np.float64, np.float64)
        return pa.table({c: np.concatenate([np.empty(0, t), *v]).astype(t) for c, t, v in zip((row_id, "d_id", "distance", "value"), kinds, out, strict=True)})

    return search


def knn_impute(df: DataFrame, targets: list[str], neighbors: int) -> DataFrame:
    """Each missing cell becomes the mean of the k nearest rows that have the feature, by distance over shared features.

    Only rows with a missing target look for neighbours, among all donors: blocks of both meet pair by pair, and the k
    nearest of each block contend for the k nearest of all. A cell without any donor takes the column's mean.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    features = [c for c in data_columns(df) if is_number(kinds[c])]
    value = lambda c: F.when(~missing(c, kinds[c]), quoted(c).cast("double"))
    points = df.select(ROW_ID, *(value(c).alias(f"f{i}") for i, c in enumerate(features)))
    means = one_row(df, {(c,): F.avg(value(c)) for c in targets} | {("rows",): F.count("*")})
    donors = points.where(F.coalesce(*(F.col(f"f{i}") for i in range(len(features)))).isNotNull())
    k = min(neighbors, max(1, means["rows",] - 1))
    out = df
    for t in targets:
        at = features.index(t)
        receivers, givers = points.where(F.col(f"f{at}").isNull()), donors.where(F.col(f"f{at}").isNotNull())
        n = one_row(points, {("receivers",): F.count_if(F.col(f"f{at}").isNull()), ("donors",): F.count(f"f{at}")})
        n_r, n_d = -(-n["receivers",] // RECEIVER_BLOCK) or 1, -(-n["donors",] // DONOR_BLOCK) or 1
        block = lambda m: F.pmod(F.xxhash64(ROW_ID), F.lit(m))
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
        receivers = receivers.withColumn("rb", block(n_r)).withColumn("db", every(n_d))
        givers = givers.withColumn("db", block(n_d)).withColumn("rb", every(n_r))
        pairs = receivers.groupBy("rb", "db").cogroup(givers.groupBy("rb", "db")).applyInArrow(_nearest(k, len(features), at), f"{ROW_ID} long, d_id long, distance double, value double")
        nearest = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(ROW_ID).orderBy("distance", "d_id"))).where(F.col("rank") <= k)
        found = nearest.groupBy(ROW_ID).agg(F.avg("value").alias("__value"))
        out = out.join(found, ROW_ID, "left")
        out = replaced(out, {t: F.coalesce(value(t), F.col("__value"), F.lit(means[t,]))}).drop("__value")
    return out


def iterative_impute(df: DataFrame, targets: list[str], rounds: int = 10) -> DataFrame:
    """Round-robin ridge regression of each target on the other numeric columns, starting from means.

    A model needs the sums of products only: one aggregation a feature and round, and a small solve on the driver. The
    fitted values are formulas over the raw columns. It is a ridge of fixed weight, not one whose weight is estimated.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    features = [c for c in data_columns(df) if is_number(kinds[c])]
    raw = {c: F.when(~missing(c, kinds[c]), quoted(c).cast("double")) for c in features}
    first = one_row(df, {(c,): F.avg(raw[c]) for c in features} | {(c, "s"): F.stddev_pop(raw[c]) for c in features})
    work = df.select(ROW_ID, *(raw[c].alias(f"r{i}") for i, c in enumerate(features)), *(F.coalesce(raw[c], F.lit(first[c,] or 0.0)).alias(f"x{i}") for i, c in enumerate(features)))
    kept = [work.persist()]
    work = kept[0]
    wanted = [i for i, c in enumerate(features) if c in targets]
    before = None
    for _ in range(rounds):
        for t in wanted:
            others = [i for i in range(len(features)) if i != t]
            if not others:
                continue
            z = {i: (F.col(f"x{i}") - (first[features[i],] or 0.0)) / (first[features[i], "s"] or 1.0) for i in others}
            terms = [F.lit(1.0), *z.values()]
            y = F.col(f"r{t}")
            sums = {(a, b): F.sum(F.when(y.isNotNull(), terms[a] * terms[b])) for a in range(len(terms)) for b in range(a, len(terms))} | {(a, "y"): F.sum(terms[a] * y) for a in range(len(terms))}
            got = one_row(work, sums)
            m = len(terms)
            xx = np.array([[got[min(a, b), max(a, b)] or 0.0 for b in range(m)] for a in range(m)])
            w = np.linalg.lstsq(xx + np.diag([0.0] + [1e-3] * (m - 1)), np.array([got[a, "y"] or 0.0 for a in range(m)]), rcond=None)[0]
            guess = sum((F.lit(float(w[k])) * terms[k] for k in range(m)), F.lit(0.0))
            work = work.withColumn(f"x{t}", F.coalesce(y, guess))
        fresh = work.persist()
        kept.append(fresh)
        now = one_row(fresh, {(i,): F.sum(f"x{i}") for i in wanted})
        if before is not None and all(abs((now[k] or 0) - (before[k] or 0)) <= 1e-6 * max(1.0, abs(now[k] or 0)) for k in now):
            work = fresh
            break
        work, before = fresh, now
    filled = stored(work.select(ROW_ID, *(F.col(f"x{i}").alias(f"__x{i}") for i in wanted)))
    for frame in kept:
        frame.unpersist()
    out = df.join(filled, ROW_ID, "left")
    return replaced(out, {features[i]: F.col(f"__x{i}") for i in wanted}).drop(*(f"__x{i}" for i in wanted))


@step("handle_missing_values")
def handle_missing_values(
    df: DataFrame,
    strategy: str = "auto",
    column_strategies: dict[str, str] | None = None,
    columns: list[str] | None = None,
    fill_value: str = "Unknown",
    numeric_fill_value: float = 0,
    drop_threshold: float = 0.60,
    row_missing_threshold: float | None = None,
    add_indicator: bool = False,
    knn_neighbors: int = 5,
    order_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    strict_parity: bool = False,
    exact_quantiles: bool = True,
) -> tuple[DataFrame, dict]:
    """Rows with too many gaps go, then each column with gaps gets its strategy; what does not apply only warns.

    Forward and backward fill and interpolation follow the rows' order; partition_by keeps them within groups. Medians are
    exact unless exact_quantiles is False. The global strategy drop_columns drops columns with gaps only, unless strict_parity.
    """
    bad = {strategy, *(column_strategies or {}).values()} - set(STRATEGIES)
    if bad:
        raise ValueError(f"unknown strategies: {sorted(bad)}")
    had = ROW_ID in df.columns
    used = {strategy, *(column_strategies or {}).values()}
    ids_twice = used & {"auto", "knn", "iterative"} or used & set(ALONG) and not partition_by
    df = with_row_id(df, order_by, keep=bool(ids_twice))
    kinds = {f.name: f.dataType for f in df.schema}
    named = resolve_columns(df, columns)
    resolve_columns(df, list(column_strategies or {}))
    report: dict = {"strategy": strategy, "columns_dropped": [], "indicators_added": [], "per_column": {}, "warnings": []}
    everything = data_columns(df)
    numeric = lambda c: is_number(kinds[c]) and not isinstance(kinds[c], T.BooleanType)
    counts = lambda d: {("rows",): F.count("*")} | {(c,): F.count_if(missing(c, kinds[c])) for c in everything if c in d.columns}
    gaps = lambda d: one_row(d, counts(d))
    ahead = {c: s for c in named if (s := (column_strategies or {}).get(c, strategy)) in ALONG and (s != "interpolate" or numeric(c))}
    if ahead and not partition_by and row_missing_threshold is None:
        ends, start = part_ends(df, ahead, counts(df))
    else:
        ends, start = None, gaps(df)
    out = df
    if row_missing_threshold is not None and everything:
        share = sum((missing(c, kinds[c]).cast("int") for c in everything), F.lit(0)) / len(everything)
        out = out.where(share <= row_missing_threshold)
    now = gaps(out) if out is not df else start
    gone = lambda c: now[c,] > 0
    plan = {}
    for c in named:
        s = (column_strategies or {}).get(c, strategy)
        if gone(c) or (strict_parity and s == "drop_columns" and c not in (column_strategies or {})):
            plan[c] = s
    auto = [c for c, s in plan.items() if s == "auto"]
    known_medians: dict[str, float] = {}
    if auto:
        chosen, known_medians = choose_strategies(out, auto, now)
        plan |= {c: "drop_columns" if now["rows",] and now[c,] / now["rows",] >= drop_threshold else chosen[c] for c in auto}
    extra = {}
    if add_indicator:
        extra = {f"{c}__was_missing": missing(c, kinds[c]) for c, s in plan.items() if s not in ("drop_columns", "drop_rows", "leave")}
        report["indicators_added"] = list(extra)
    value = lambda c: F.when(~missing(c, kinds[c]), quoted(c))
    for c, s in list(plan.items()):
        if s in ("mean", "median", "interpolate", "knn", "iterative") and not numeric(c):
            report["warnings"].append(f"{c}: {s} needs a numeric column; its gaps stay")
            plan[c] = "leave"
        elif s == "constant" and not (numeric(c) or is_text(kinds[c])):
            report["warnings"].append(f"{c}: a constant of another type does not fit; its gaps stay")
            plan[c] = "leave"
        elif s == "mode" and is_nested(kinds[c]):
            report["warnings"].append(f"{c}: nested values have no mode; its gaps stay")
            plan[c] = "leave"
    stats = one_row(out, {(c,): F.avg(value(c)) for c, s in plan.items() if s == "mean"})
    found = known_medians if exact_quantiles else {}
    middle = quantiles(out, {c: value(c).cast("double") for c, s in plan.items() if s == "median" and c not in found}, (0.5,), exact_quantiles)
    stats |= {(c,): found[c] if c in found else middle[c, 0.5] for c, s in plan.items() if s == "median"}
    stats |= most_frequent(out, {c: value(c) for c, s in plan.items() if s == "mode"})
    new = dict(extra)
    for c, s in plan.items():
        if s in ("mean", "median") and stats[c,] is not None:
            new[c] = F.coalesce(value(c).cast("double"), F.lit(float(stats[c,])))
        elif s == "mode" and stats[c,] is not None:
            new[c] = F.coalesce(value(c), F.lit(stats[c,]).cast(kinds[c]))
        elif s == "constant":
            new[c] = F.coalesce(value(c), F.lit(numeric_fill_value if numeric(c) else fill_value).cast(kinds[c]))
    out = replaced(out, new)
    along, end = {c: s for c, s in plan.items() if s in ALONG}, None
    if along:
        filled, left = ordered_fill(out, along, partition_by or [], not had, ends if along.keys() <= ahead.keys() else None)
        if len(left) == len(along) and not {"drop_rows", "knn", "iterative"} & set(plan.values()):
            others = now if set(plan.values()) <= {*ALONG, "leave", "drop_columns"} else gaps(out.drop(*along))
            end = others | {(c,): n for c, n in left.items()}  # the filled rows need not be made for their count
        out = filled
    drop = [c for c, s in plan.items() if s == "drop_rows"]
    if drop:
        keep = ~missing(drop[0], kinds[drop[0]])
        for c in drop[1:]:
            keep = keep & ~missing(c, kinds[c])
        out = out.where(keep)
    for s, f in (("knn", lambda d, t: knn_impute(d, t, knn_neighbors)), ("iterative", iterative_impute)):
        t = [c for c, x in plan.items() if x == s]
        if t:
            order = out.columns
            out = f(out, t).select(*(quoted(c) for c in order))
    report["columns_dropped"] = [c for c, s in plan.items() if s == "drop_columns"]
    out = out.drop(*report["columns_dropped"])
    end = {k: n for k, n in end.items() if k == ("rows",) or k[0] in out.columns} if end else gaps(out)
    report["per_column"] = {c: {"strategy": s, "missing": now[c,], "missing_pct": percent(now[c,], now["rows",])} for c, s in plan.items()}
    report["rows_dropped"] = start.pop(("rows",)) - end.pop(("rows",))
    report["missing_before"], report["missing_after"] = sum(start.values()), sum(end.values())
    report["values_imputed"] = max(0, report["missing_before"] - report["missing_after"])
    return out if had else out.drop(ROW_ID), report
