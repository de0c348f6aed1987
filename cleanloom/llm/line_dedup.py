"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations only.

Each document is the sequence of its lines' IDs (two 64-bit hashes of the line; blank lines are skipped). Prefix doubling
ranks the suffixes of all documents together: by their first line, then by their first 2, 4, ... lines, each time from the
order of the pairs (rank here, rank so many lines on). The ranks are the suffix array turned round: they grow with the order
of the suffixes, and suffixes of equal rank are an interval whose longest common prefix is at least that many lines. A run
that occurs once has no rank, and neither has any longer one that begins with it, so each round goes on with the rest only.

Doubling stops at the power of two below `min_words`, as a run of that many words has no more lines. The interval at
any depth up to twice that is the group of equal pairs (rank of the run's first lines, rank of its last ones). It is enough to
look at the shortest run of `min_words` words that starts at each suffix and the shortest that ends at each line: a maximal
repeated run is the union of the ones inside it. Every run of an interval but its first occurrence, by doc_id and line, is
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cleanloom.llm._common import WORD, cut, joined, removed, written

#: A document by its id and a hash of its id and text; a stretch of it without lines that occur once.
DOC = ["doc_id", "rid"]
STRETCH = [*DOC, "stretch"]


def line_ids(docs: DataFrame) -> DataFrame:
    """doc_id, rid, i, at, w, a and b for each line that has words: its number among such lines, its number among all, its words, and its ID."""
    item = lambda x, at: F.struct(at.alias("at"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(3), x).alias("b"))
    full = F.filter(F.transform(F.split("text", "\n"), item), lambda x: x["w"] > 0)
    rows = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), F.posexplode(full).alias("i", "l"))
    return rows.select("doc_id", "rid", "i", "l.*")


def ranks(keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """The keys that occur more than once, with a number that grows with their order; kept, as the numbers depend on the partitions."""
    several = keys.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return cut(several.orderBy(*on).withColumn(name, F.monotonically_increasing_id()))


def _with_rank(rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """rows with the rank of their key; null where a key is null or occurs once. Null keys meet no join."""
    known = " and ".join(f"{c} is not null" for c in on)
    found = ranks(rows.where(known).select(*on), on, name)
    none = rows.where(f"not ({known})").withColumn(name, F.lit(None).cast("long"))
    return joined(rows.where(known), found, on, "left").unionByName(none)


def suffix_ranks(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, rid, stretch, i, at, w, upto and r for each line of a stretch of repeated lines that has min_words words or more.

    r holds the ranks of the suffix by its first 1, 2, 4, ... lines; upto are the stretch's words up to the line.
    """
    lines, path = written(line_ids(docs), "line-ids")
    rows = joined(lines, ranks(lines, ["a", "b"], "r0"), ["a", "b"], "inner").drop("a", "b")
    of_doc, of_stretch = Window.partitionBy(*DOC).orderBy("i"), Window.partitionBy(*STRETCH).orderBy("i")
    rows = rows.withColumn("before", F.lag("i").over(of_doc)).where("before is null or before < i").drop("before")  # rows that repeat
    rows = rows.withColumn("stretch", F.col("i") - F.row_number().over(of_doc))
    rows = rows.withColumn("words", F.sum("w").over(Window.partitionBy(*STRETCH))).where(F.col("words") >= min_words).drop("words")
    rows = cut(rows.withColumn("upto", F.sum("w").over(of_stretch.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    removed(docs.sparkSession, path)
    names = ["r0"]
    for k in range(min_words.bit_length() - 1):
        doubled = _with_rank(rows.withColumn("next", F.lead(names[-1], 1 << k).over(of_stretch)), [names[-1], "next"], f"r{k + 1}")
        rows = cut(doubled.drop("next"))
        names.append(f"r{k + 1}")
        if rows.where(F.col(names[-1]).isNotNull()).isEmpty():
            break
    return rows.select(*STRETCH, "i", "at", "w", "upto", F.array(*names).alias("r"))


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """Runs of lines to delete: doc_id, rid and spans, an array of (s, e) line numbers, both counted in, from 0.

    rid is a hash of doc_id and text that tells rows of the same doc_id apart.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    suffixes = suffix_ranks(docs, min_words)
    rows = suffixes.groupBy(*STRETCH).agg(F.array_sort(F.collect_list(F.struct("i", "at", "w", "upto", "r"))).alias("l")).withColumn("n", F.size("l"))
    powers = [1 << k for k in range(min_words.bit_length() - 1, -1, -1)]
    line = lambda i: F.get("l", i)

    def most_below(words) -> Column:
        """The most lines that together have fewer than min_words words, words(n) being those of n lines; null beyond the end."""
        return F.aggregate(F.array(*map(F.lit, powers)), F.lit(0), lambda n, p: n + F.when(words(n + p) < min_words, p).otherwise(0))

    number = F.sequence(F.lit(0), F.col("n") - 1)
    forward = F.transform(number, lambda i: most_below(lambda n: line(i + n - 1)["upto"] - line(i)["upto"] + line(i)["w"]) + 1)
    backward = F.transform(number, lambda j: most_below(lambda n: line(j)["upto"] - line(j - n + 1)["upto"] + line(j - n + 1)["w"]) + 1)
    rows = rows.withColumn("fwd", forward).withColumn("bwd", backward)
    ahead = F.filter(F.transform("fwd", lambda n, i: F.struct(i.alias("i"), n.alias("len"))), lambda x: x["i"] + x["len"] <= F.col("n"))
    back = F.filter(F.transform("bwd", lambda n, j: F.struct((j - n + 1).alias("i"), n.alias("len"))), lambda x: (x["i"] >= 0) & (F.get("fwd", x["i"]) != x["len"]))

    def named(x):
        k = F.floor(F.log2(x["len"])).cast("int")
        rank = lambda i: F.get(line(i)["r"], k)
        last = x["i"] + x["len"]
        return F.struct(x["len"].alias("len"), rank(x["i"]).alias("x"), rank(last - F.get(F.array(*(F.lit(1 << j) for j in range(min_words.bit_length()))), k)).alias("y"), line(x["i"])["at"].alias("s"), line(last - 1)["at"].alias("e"), line(x["i"])["i"].alias("i"), line(last - 1)["i"].alias("j"))

    runs = rows.select(*DOC, F.explode(F.transform(F.concat(ahead, back), named)).alias("run")).select(*DOC, "run.*").where("x is not null and y is not null")
    runs = cut(runs)
    interval = ["len", "x", "y"]
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"), F.col("s").alias("s"))
    first = cut(runs.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = joined(runs, first, interval, "inner").where(place > F.col("first"))
    spans = F.array_sort(F.collect_set(F.struct("s", "e", "i", "j")))
    return later.groupBy(*DOC).agg(spans.alias("spans")).select(*DOC, _merged(F.col("spans")).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans of lines s to e, those joined whose lines with words, i to j, touch or overlap; blank lines between go along."""
    start = F.struct(F.filter(spans, lambda x: F.lit(False)).alias("done"), F.get(spans, F.lit(0)).alias("now"))

    def step(state, x):
        now = state["now"]
        longer = F.struct(now["s"].alias("s"), F.greatest(now["e"], x["e"]).alias("e"), now["i"].alias("i"), F.greatest(now["j"], x["j"]).alias("j"))
        same = F.struct(state["done"].alias("done"), longer.alias("now"))
        new = F.struct(F.array_append(state["done"], now).alias("done"), x.alias("now"))
        return F.when(x["i"] <= now["j"] + 1, same).otherwise(new)

    return F.aggregate(spans, start, step, lambda s: F.array_append(s["done"], s["now"]))


def drop_repeated_lines(docs: DataFrame, min_words: int = 50, report: bool = False) -> DataFrame:
    """The rows of docs (doc_id long, text string, any others) without later copies of repeated line runs.

    A run is deleted where a run of the same lines, of min_words words or more together, occurs earlier, by doc_id (null
    last) and line; blank lines do not count, and go where the lines around them do. Lines are compared exactly. A document that loses all its lines with
    words is dropped. n_chars, if there, is set anew for changed texts; texts that lose nothing, null and empty texts stay as they are.
    Rows that repeat a doc_id with the same text are treated alike; with other texts they are ordered by a hash. With
    `report`, no row is dropped, and the columns n_lines, n_removed and kept are added. An empty table gives an empty result.
    """
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    names = docs.columns
    inner = plain.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    keyed = inner.withColumn("rid", F.xxhash64(doc_id, text)).withColumn("id", F.coalesce(doc_id, F.lit(0)))
    runs = repeated_runs(inner.select(doc_id.alias("doc_id"), text.cast("string").alias("text")), min_words)
    runs = cut(runs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), "rid", "spans"))
    both = joined(keyed, runs, ["id", "rid"], "left")
    lines = F.split(text, "\n")
    gone = lambda i: F.exists("spans", lambda x: (i >= x["s"]) & (i <= x["e"]))
    left = F.filter(lines, lambda x, i: ~gone(i))
    out = both.withColumn("left", F.when(F.col("spans").isNotNull(), left))
    kept = F.col("left").isNull() | F.exists("left", lambda x: F.regexp_count(x, F.lit(WORD)) > 0)
    changed = F.when(F.col("left").isNotNull(), F.array_join("left", "\n")).otherwise(text)
    columns = []
    for i, c in enumerate(names):
        column = F.col(f"c{i}")
        if c == "text":
            column = changed
        elif c == "n_chars":
            column = F.when(F.col("left").isNotNull(), F.length(changed).cast(docs.schema[i].dataType)).otherwise(column)
        columns.append(column.alias(c))
    if report:
        n = F.coalesce(F.size(lines), F.lit(0))
        return out.select(*columns, n.cast("long").alias("n_lines"), (n - F.coalesce(F.size("left"), n)).cast("long").alias("n_removed"), kept.alias("kept"))
    return out.where(kept).select(*columns)
