"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Text and benchmark items become templates: numbers, names and units turn into typed placeholders, the rest is lowered and
loses the punctuation around words, word by word, so that a template has as many tokens as the text has words. Windows of
five template tokens are hash-joined. A document holds an item when enough of the item's windows lie in it at
one alignment, give or take a drift of some words, and when the slots agree: each value in the item's slots must stand
for one value in the document's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cleanloom.llm._common import cut, joined, words

#: The placeholders: control characters, which no word pattern below touches; they leave a text in one byte a character where it was.
NUMBER, UNIT, NAME = "\x01", "\x02", "\x03"
#: The sign before a capitalised word that begins a text or a sentence: a name or not.
MARK = "\x04"
#: Units of measure that turn into a placeholder after a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons oz lb lbs ml l liter liters litre litres "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "c f k hz khz mhz ghz w kw mw v a j kj cal kcal kmh mph % $ usd eur dollar dollars euro euros cent cents"
).split()
#: Words that stand for numbers.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Tokens of a window, and how many of them must be no placeholder for the window to count.
WINDOW, LITERALS = 5, 2
#: Words by which any item may drift within a document.
DRIFT = 8
#: Slots that windows fall into by their first two tokens; a byte each in the plan.
SLOTS = 1 << 15


#: Signs that fall away before the patterns run (in two classes, as a class of small characters is matched fast), and those
#: that end sentences and fall away after them.
SOFT, HARD = (r"""[\x01-\x04,;"'()\[\]{}<>«»]+""", r"[‘-„…]+"), r"[.!?:]+"


def _without(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


#: What names a row of docs: its doc_id, 0 for null, and a hash of its doc_id and text.
DOC = ["id", "rid"]


def _name(doc_id: Column, text: Column) -> list[Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id"), F.xxhash64(doc_id.cast("long"), text.cast("string")).alias("rid")]


def _bare(text: Column) -> Column:
    """The words that slots are read from; as many as the template has tokens."""
    return words(F.lower(_without(F.coalesce(text, F.lit("")), *SOFT, HARD)))


def _either(words: list[str]) -> str:
    """A pattern for any of the words, by their first letters, so that most text fails at the first."""
    return "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True))})" for c in sorted({w[0] for w in words}))


def template(text: Column) -> Column:
    """The template tokens of a text; a capitalised word that begins a sentence keeps its letters behind a MARK. Each pattern begins with the character that it needs, so that most text is passed over fast."""
    blank = r"[\x20\x09-\x0D]"
    t = F.concat(F.lit(" "), _without(F.coalesce(text, F.lit("")), *SOFT))
    number = _either(NUMBER_WORDS)
    t = F.regexp_replace(t, rf"{blank}(?i:(?:{number})(?:-(?:{number}))*)(?=[.!?:]*(?:{blank}|$))", f" {NUMBER}")
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<=[^\x20\x09-\x0D.!?:]{blank}\p{{Lu}})\p{{Ll}}+(?=[.!?:]*(?:{blank}|$))", NAME)
    t = F.regexp_replace(t, rf"\p{{Lu}}(?<![^\x20\x09-\x0D]\p{{Lu}})\p{{Ll}}+(?=[.!?:]*(?:{blank}|$))", f"{MARK}$0")
    t = F.regexp_replace(t, r"\p{N}(?<![\p{L}\p{N}].)\p{N}*(?:[.:/]\p{N}+)*", NUMBER)
    t = F.regexp_replace(t, rf"{NUMBER}({blank}?)(?i:{'|'.join(u.replace('$', '[$]') for u in sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1{UNIT}")
    return words(F.lower(_without(t, HARD)))


def _slot(tokens: Column, i: Column) -> Column:
    """The slot of a window by its first two tokens; which slots any item has is known, so that most windows are never made."""
    mixed = F.get(tokens, i - 1).bitwiseXOR(F.shiftrightunsigned(F.get(tokens, i), 9))
    return mixed.bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def _positions(source: DataFrame, keys: list[str], slots: bytes | None = None) -> DataFrame:
    """keys, window hash w, position p, loose and slot for each window of the texts that falls in one of the slots.

    A window with words that begin a sentence has two rows: with these words as they are, and, loose, as names.
    """
    first = lambda w: F.startswith(w, F.lit(MARK))
    rows = source.select(*keys, template(F.col("text")).alias("t"))
    rows = rows.select(*keys, "t", F.transform("t", lambda w: F.xxhash64(F.when(first(w), F.substr(w, F.lit(2))).otherwise(w))).alias("h"))
    rows = rows.select(*keys, "t", "h", F.zip_with("t", "h", lambda w, x: F.when(first(w), F.xxhash64(F.lit(NAME))).otherwise(x)).alias("g"))
    number = F.sequence(F.lit(1), F.size("h") - WINDOW + 1)
    asked = lambda c: lambda i: F.lit(True) if slots is None else F.substring(F.lit(slots), _slot(F.col(c), i) + 1, 1) == F.lit(b"\x01")
    window = lambda c, loose: lambda i: F.struct((i - 1).alias("p"), F.lit(loose).alias("loose"), _slot(F.col(c), i).alias("slot"), F.xxhash64(F.slice(c, i, WINDOW)).alias("w"))
    over = F.filter(F.filter(number, asked("g")), lambda i: F.exists(F.slice("t", i, WINDOW), first))
    hashes = F.concat(F.transform(F.filter(number, asked("h")), window("h", False)), F.transform(over, window("g", True)))
    return rows.select(*keys, F.explode(F.when(F.size("h") >= WINDOW, hashes)).alias("s")).select(*keys, "s.p", "s.loose", "s.slot", "s.w")


def _matched(band: str) -> Column:
    """How many windows of the item the offsets of a band match, each counted once."""
    return F.size(F.array_distinct(F.flatten(F.transform(band, lambda b: b["qs"]))))


def _bands(found: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """keys and band, the offsets (offset, qs) that lie together: each offset alone, and each run of offsets within the drift.

    Words put in or taken out shift the rest of an item; it may drift by as many words as windows may be missing, DRIFT at least.
    """
    drift = F.greatest(F.lit(DRIFT), F.floor(F.col("n_windows") * (den - num) / den).cast("int"))
    starts = found.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), drift), lambda k: F.col("at.offset") - k)))
    wide = starts.groupBy(*keys, "start").agg(F.array_sort(F.collect_list("at")).alias("band")).drop("start")
    both = found.select(*keys, F.array("at").alias("band")).unionByName(wide)
    return both.withColumn("offsets", F.col("band.offset")).dropDuplicates([*keys, "offsets"]).drop("offsets")


def _kinds(text: Column) -> Column:
    """A letter for each template token: n for a name, m for a word that begins a sentence, s for another slot, x for the rest."""
    kind = lambda w: F.when(w == NAME, "n").when(F.startswith(w, F.lit(MARK)), "m").when(F.rlike(w, F.lit(f"[{NUMBER}{UNIT}{NAME}]")), "s").otherwise("x")
    return F.array_join(F.transform(template(text), kind), "")


def _place(i: Column) -> Column:
    """The offset of the item's token i in the band: that of the matched windows over it, of most windows if there are several.

    A token under no matched window has a place only where the band is a single offset.
    """
    over = F.filter("band", lambda b: F.exists(b["qs"], lambda q: (q <= i) & (q > i - WINDOW)))
    best = F.array_min(F.transform(over, lambda b: F.struct((-F.size(b["qs"])).alias("n"), b["offset"].alias("offset"))))
    return F.coalesce(best["offset"], F.when(F.size("band") == 1, F.element_at("band", 1)["offset"]))


def _pair(i: Column, p: Column) -> Column:
    """The value x of the item's slot i and y of the document's slot p; whole names where they differ in their number of words."""
    its, own, mine, theirs = F.col("its"), F.col("own"), F.col("its_kinds"), F.col("own_kinds")
    run = lambda kinds, pattern="^n*": F.length(F.regexp_extract(kinds, pattern, 0))
    kind = lambda kinds, at: F.substr(kinds, at + 1, F.lit(1))
    begins = lambda kinds, at: F.reverse(F.substr(kinds, F.lit(1), at))
    before = lambda kinds, at: F.when(kind(kinds, at) == "n", F.when(kind(mine, i) == "m", run(begins(kinds, at), "^n*m?")).otherwise(run(begins(kinds, at)))).otherwise(0)
    after = lambda kinds, at: F.when(kind(kinds, at) == "n", run(F.substr(kinds, at + 1))).when(kind(kinds, at) == "m", run(F.substr(kinds, at + 2)) + 1).otherwise(1)
    whole = lambda tokens, kinds, at: F.array_join(F.slice(tokens, at + 1 - before(kinds, at), before(kinds, at) + after(kinds, at)), " ")
    same = before(mine, i) + after(mine, i) == before(theirs, p) + after(theirs, p)
    x = F.when(same, F.get(its, i)).otherwise(whole(its, mine, i))
    y = F.when(same, F.get(own, p - before(theirs, p) + before(mine, i))).otherwise(whole(own, theirs, p))
    return F.struct(x.alias("x"), F.when(F.get(own, p).isNotNull(), y).alias("y"))


def contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """id, rid, item_id, n_windows, n_matched and exact for each document and item that it holds.

    Numbers, in digits or in words, units after numbers, and names are slots. An item is held when in one band of alignments den * matched windows >= num * all windows of the item, and its slots agree.
    Capitalised words that begin a text or a sentence are judged twice: as plain words, and as names, which are slots then
    unless the item has them in lower case as well.
    exact says that the slots' values are the item's own. id is doc_id, 0 for null, and rid a hash of doc_id and text. Items without a window, such as those of fewer than five words, and null or empty texts are never held. A text is
    searched whole, however long. Items that repeat count once; other columns are ignored.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    slot = lambda w, signs: F.when(F.rlike(w, F.lit(f"[{signs}]")), 0).otherwise(1)
    literal = lambda signs: F.transform(template(F.col("text")), lambda w: slot(w, signs))
    marks = items.select("item_id", F.xxhash64("text").alias("iid"), literal(NUMBER + UNIT + NAME).alias("lit"), literal(NUMBER + UNIT + NAME + MARK).alias("loose_lit"))
    enough = F.aggregate(F.slice(F.when(F.col("loose"), F.col("loose_lit")).otherwise(F.col("lit")), F.col("q") + 1, WINDOW), F.lit(0), lambda a, x: a + x) >= LITERALS
    item_windows = _positions(items.withColumn("iid", F.xxhash64("text")), ["item_id", "iid"]).withColumnRenamed("p", "q")
    item_windows = cut(item_windows.join(marks, ["item_id", "iid"]).where(enough).select("w", "slot", "item_id", "iid", "q", "loose"))
    slots = bytearray(SLOTS)
    for r in item_windows.select("slot").distinct().collect():  # SLOTS rows at most
        slots[r.slot] = 1
    item_windows = item_windows.drop("slot")
    counts = item_windows.where("not loose").groupBy("item_id", "iid").agg(F.count("*").alias("n_windows"))
    item_windows = item_windows.join(counts, ["item_id", "iid"])
    plain = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    plain = plain.select(*_name(F.col("doc_id"), F.col("text")), "text")
    found = joined(_positions(plain, DOC, bytes(slots)).drop("loose", "slot"), item_windows, ["w"], "inner")
    keys = [*DOC, "item_id", "iid", "n_windows", "loose"]
    found = found.groupBy(*keys[:-1], (F.col("p") - F.col("q")).alias("offset")).agg(F.collect_set(F.when(~F.col("loose"), F.col("q"))).alias("strict"), F.collect_set("q").alias("qs"))
    both = F.array(F.struct(F.lit(False).alias("loose"), F.col("strict").alias("qs")), F.struct(F.lit(True).alias("loose"), F.col("qs")))
    found = found.select(*keys[:-1], "offset", F.explode(both).alias("s")).select(*keys[:-1], "s.loose", "offset", "s.qs").where("size(qs) > 0")
    found = found.groupBy(*keys).agg(F.collect_list(F.struct("offset", "qs")).alias("band")).where(_matched("band") * den >= F.col("n_windows") * num)
    found = cut(found.select(*keys, F.explode("band").alias("at")))
    found = cut(_bands(found, keys, num, den).withColumn("n_matched", _matched("band")).where(F.col("n_matched") * den >= F.col("n_windows") * num))
    # the slots of the few documents that are left
    texts = joined(plain, found.select(*DOC).distinct(), DOC, "left_semi").dropDuplicates(DOC)
    item_texts = items.select("item_id", F.xxhash64("text").alias("iid"), _bare(F.col("text")).alias("its"), _kinds(F.col("text")).alias("its_kinds"))
    slots = found.join(texts.select(*DOC, _bare(F.col("text")).alias("own"), _kinds(F.col("text")).alias("own_kinds")), DOC).join(item_texts, ["item_id", "iid"])
    kind = lambda i: F.substr("its_kinds", i + 1, F.lit(1))
    slots = slots.withColumn("small", F.filter("its", lambda w, i: kind(i) == "x"))
    number = F.filter(F.sequence(F.lit(0), F.size("its") - 1), lambda i: F.when(kind(i) == "m", F.col("loose") & ~F.array_contains("small", F.get("its", i))).otherwise(kind(i) != "x"))
    pairs = F.transform(F.transform(number, lambda i: F.struct(i.alias("i"), (i + _place(i)).alias("p"))), lambda s: _pair(s["i"], s["p"]))
    slots = slots.withColumn("pairs", F.array_distinct(F.filter(pairs, lambda s: s["y"].isNotNull())))
    slots = slots.withColumn("agree", F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda s: s["x"]))))
    slots = slots.withColumn("exact", ~F.exists("pairs", lambda s: s["x"] != s["y"]))
    held = slots.where("agree").groupBy(*DOC, "item_id")
    return held.agg(F.max("n_windows").alias("n_windows"), F.max("n_matched").alias("n_matched"), F.bool_or("exact").alias("exact"))


def decontamination_report(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, contaminated, n_items, item_id and coverage for every row of docs.

    item_id is the item with the largest share of matched windows, the smallest id of several; coverage is that share.
    Both are null for a clean document. Rows that repeat a doc_id are judged each by its own text. Empty tables are fine.
    """
    held = contaminated(docs, benchmark, num, den)
    best = F.min(F.struct((-F.col("n_matched") / F.col("n_windows")).alias("share"), "item_id"))
    held = cut(held.groupBy(*DOC).agg(F.count("*").alias("n_items"), best.alias("best")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_name(F.col("doc_id"), F.col("text")))
    out = joined(rows, held, DOC, "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("best.item_id").alias("item_id"), (-F.col("best.share")).alias("coverage"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of benchmark."""
    held = cut(contaminated(docs, benchmark, num, den).select(*DOC).distinct())
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}")
    return joined(inner.select("*", *_name(doc_id, text)), held, DOC, "left_anti").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
