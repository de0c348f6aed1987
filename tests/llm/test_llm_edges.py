"""Odd tables for every operator and pipeline stage, and decontamination, links and stages against brute force."""

import itertools
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from cleanloom.llm import _components
from cleanloom.llm.cap_filters import cap_filter_links
from cleanloom.llm.decontamination import NUMBER_WORDS, UNITS, contaminated, decontamination_report, drop_contaminated
from cleanloom.llm.url_filter import url_verdicts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SOFT, HARD = ",;\"'()[]{}<>«»“”„‘’‚‛…\x01\x02\x03\x04", ".!?:"


def prose(seed, n, alphabet="abcdefgh"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices(alphabet, k=draw.randint(2, 5))) for _ in range(n))


# --- decontamination ---


def brute_tokens(text):
    """(template token, bare word, kind) for each word: n a name, m a capitalised word that begins a sentence, s another slot, x the rest."""
    numbers, units = "|".join(NUMBER_WORDS), set(UNITS)
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    out = []
    for k, w in enumerate(words):
        soft = w.translate({ord(c): None for c in SOFT})
        bare = soft.translate({ord(c): None for c in HARD})
        if not bare:
            continue
        low = bare.lower()
        before = words[k - 1].translate({ord(c): None for c in SOFT}) if k else ""
        if regex.fullmatch(rf"(?i)({numbers})(-({numbers}))*[.!?:]*", soft) or regex.fullmatch(r"\p{N}+([.:/]\p{N}+)*[.!?:]*", soft):
            out.append(("#", low, "s"))
        elif out and out[-1][0] == "#" and low in units:
            out.append(("%u", low, "s"))
        elif regex.fullmatch(r"\p{Lu}\p{Ll}+[.!?:]*", soft):
            out.append(("@", low, "n") if before and before[-1] not in HARD else (low, low, "m"))
        else:
            out.append((low, low, "x"))
    return out


def brute_held(text, item, num, den, width=5, literals=2, least_drift=8):
    """Whether a text holds an item, by trying every band of alignments one by one."""
    doc, its = brute_tokens(text), brute_tokens(item)
    loosened = lambda t: "@" if t[2] == "m" else t[0]
    windows = lambda toks, f: {i: tuple(f(t) for t in toks[i : i + width]) for i in range(len(toks) - width + 1)}
    strict = {i: w for i, w in windows(its, lambda t: t[0]).items() if sum(t[2] in "xm" for t in its[i : i + width]) >= literals}
    loose = {i: w for i, w in windows(its, loosened).items() if any(t[2] == "m" for t in its[i : i + width]) and sum(t[2] == "x" for t in its[i : i + width]) >= literals}
    if not strict:
        return False
    drift = max(least_drift, len(strict) * (den - num) // den)
    found = {False: {}, True: {}}
    for p, w in itertools.chain(windows(doc, lambda t: t[0]).items(), ((p, w) for p, w in windows(doc, loosened).items() if any(t[2] == "m" for t in doc[p : p + width]))):
        for q, v in strict.items():
            if v == w:
                found[False].setdefault(p - q, set()).add(q)
                found[True].setdefault(p - q, set()).add(q)
        for q, v in loose.items():
            if v == w:
                found[True].setdefault(p - q, set()).add(q)
    small = {t[1] for t in its if t[2] == "x"}
    for names, offsets in found.items():
        bands = [[o] for o in offsets] + [[o for o in offsets if s <= o <= s + drift] for s in range(min(offsets, default=0) - drift, max(offsets, default=0) + 1)]
        for band in bands:
            if len(set().union(*(offsets[o] for o in band))) * den < len(strict) * num:
                continue
            pairs = set()
            for i, t in enumerate(its):
                if t[2] == "x" or t[2] == "m" and (not names or t[1] in small):
                    continue
                over = sorted((-len(offsets[o]), o) for o in band if any(q <= i < q + width for q in offsets[o]))
                place = over[0][1] if over else band[0] if len(band) == 1 else None
                if place is not None and 0 <= i + place < len(doc):
                    pairs.add((t[1], doc[i + place][1]))
            if len({x for x, _ in pairs}) == len(pairs):
                return True
    return False


def test_decontamination_equals_brute_force(spark):
    """Random items and re-parameterised, shifted, broken and unrelated documents, with names of one word."""
    draw, names = random.Random(6), ["Tom", "Ann", "Mary", "Eve", "Rose"]
    plain = ["gives", "the", "old", "mill", "near", "river", "and", "has", "apples", "before", "with", "walks", "rope", "then"]

    def sentence():
        words = [draw.choice(plain) for _ in range(draw.randint(6, 12))]
        for _ in range(draw.randint(0, 3)):
            words.insert(draw.randrange(1, len(words)), draw.choice([draw.choice(names), str(draw.randrange(2, 99)), draw.choice(["five", "Twelve", "ninety-nine"]), f"{draw.randrange(2, 9)} km"]))
        words[0] = draw.choice([words[0], words[0].title(), draw.choice(names)])
        return " ".join(words) + "."

    items = {i: " ".join(sentence() for _ in range(draw.randint(1, 4))) for i in range(12)}

    def varied(text):
        swap = dict(zip(names, draw.sample(names, len(names)), strict=True))
        out = [swap.get(w.strip("."), w.strip(".")) + "." * w.endswith(".") if w.strip(".") in swap else w for w in text.split()]
        for _ in range(draw.choice([0, 0, 1, 2])):
            k = draw.randrange(len(out))
            out[k : k + 1] = draw.choice([[], [out[k], "extra"], ["zzz"], [draw.choice(names)]])
        return " ".join(out)

    docs = {k: " ".join(([prose(k, draw.randint(0, 9))] if draw.random() < 0.5 else []) + [varied(items[draw.randrange(12)]) for _ in range(draw.randint(1, 2))]) for k in range(150)}
    docs |= {200: "", 201: prose(1, 40), 202: items[3]}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), bench, 70, 100)
    got = {(r.id, r.item_id) for r in found.collect()}
    want = {(k, i) for k, t in docs.items() for i, x in items.items() if brute_held(t, x, 70, 100)}
    assert got == want and len(want) > 60


def test_decontamination_number_words(spark):
    item = "the farmer sold 14 sheep and bought 3 cows at the market before he went home to rest"
    texts = [item.replace("14", "fourteen"), item.replace("14", "Twenty-one").replace("3", "five"), item.replace("14", "some"), item.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination_report(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), 80, 100).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True}


def test_decontamination_odd_rows(spark):
    """Items in a tie: the smaller id is named. A null id, repeated rows, very long texts, and clashing columns."""
    item = prose(3, 30)
    bench = spark.createDataFrame([(9, item), (4, item), (4, item), (5, None), (None, prose(8, 30))], "item_id long, text string").withColumn("rid", F.lit("x"))
    rows = [(1, f"{prose(5, 30_000)} {item}"), (1, f"{prose(5, 30_000)} {item}"), (None, item), (2, None), (3, ""), (1, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(7)).withColumn("w", F.lit(1))
    got = sorted((tuple(r) for r in decontamination_report(docs, bench).collect()), key=str)
    assert got == sorted([(1, True, 2, 4, 1.0), (1, True, 2, 4, 1.0), (1, False, 0, None, None), (None, True, 2, 4, 1.0), (2, False, 0, None, None), (3, False, 0, None, None)], key=str)
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.text is not None) == [(1, "other"), (3, "")]
    assert decontamination_report(docs.where("false"), bench).count() == 0 and not decontamination_report(docs, bench.where("false")).where("contaminated").count()


# --- URLs, vectors ---


def test_url_odd_rows(spark):
    rules = spark.createDataFrame([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("block", None, "/"), (None, "c", "/"), ("allow", "A.B", None)], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/x"), (1, "http://a.b/x"), (None, "http://z.A.B"), (2, "http://ab/" + "x/" * 50_000)], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_verdicts(pages, rules, default="block").collect()), key=str)
    assert got == sorted([(1, "a.b", "a.b/x", "block"), (1, "a.b", "a.b/x", "block"), (None, "z.a.b", "a.b", "allow"), (2, "ab", None, "block")], key=str)
    assert url_verdicts(pages.where("false"), rules).count() == 0


def brute_links(vectors, threshold=0.9):
    """vec_id to (links, component) by comparing all with all."""
    unit = {}
    for i, v in vectors.items():
        x = None if v is None or any(c is None for c in v) else np.array(v, np.longdouble)
        if x is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = x / np.sqrt((x / np.abs(x).max() @ (x / np.abs(x).max()))) / np.abs(x).max()
    near = {i: {j for j in unit if i != j and i in unit and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= threshold} for i in vectors}
    out = {}
    for i in sorted(vectors):
        seen, waiting = {i}, [i]
        while waiting:
            waiting += (new := near[waiting.pop()] - seen)
            seen |= new
        out[i] = (len(near[i]), min(seen))
    return out


@pytest.mark.parametrize("dim", [2, 16, 64, 384])
def test_links_by_dimension(spark, dim):
    draw = np.random.default_rng(dim)
    base = draw.standard_normal((80, dim))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = draw.standard_normal((80, dim))
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base, base + 0.45 * noise, base[:20] + 0.2 * noise[:20]])
    vectors = dict(enumerate(x.tolist()))
    want = brute_links(vectors)
    got = {r.vec_id: r for r in cap_filter_links(spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _ in want.values())


def test_links_odd_rows(spark):
    big, small = [1e200, 2e200, 3e200, 1e200], [1e-200, 2e-200, 3e-200, 1e-200]
    one = [1.0, 2.0, 3.0, 1.0]
    vectors = {1: one, 2: big, 3: small, 4: [1.0, 2.0, 3.0], 5: [0.0] * 4, 6: [1.0, None, 3.0, 1.0], 7: [], 8: None, 9: [float("inf"), 0.0, 0.0, 0.0], 10: [-x for x in one], 11: one}
    rows = [*vectors.items(), (1, one), (None, one)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("x")).withColumn("vector", F.lit(1)).withColumn("filter", F.lit(2))
    got = sorted((tuple(r)[:3] for r in cap_filter_links(df).collect()), key=str)
    want = brute_links(vectors)
    assert got == sorted([*((i, *want[i]) for i in vectors), (1, *want[1]), (None, 0, None)], key=str)
    assert cap_filter_links(df.where("false")).count() == 0
    group = spark.range(1500).selectExpr("id AS vec_id", "array(1.0f, cast(id as float) / 1e5f, 0.5f, 2.0f) AS embedding")
    assert cap_filter_links(group).select("n_links", "component_id").distinct().collect() == [(1499, 0)]


# --- pipeline stages ---


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    good, bad = {i: prose(i, 120) for i in range(60)}, {100 + i: " | ".join(prose(i, 60).upper().split()) for i in range(60)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in (good | bad).items()], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), 0) for i in good | bad], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(900, 40)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns whose names clash with inner ones."""
    long = prose(1, 30_000)
    rows = [(1, None, "en", None, None), (None, None, None, None, None), (2, "", None, "a", 0), (3, " \n\t ", "en", "a", 4), (4, long, "en", "b", 1), (4, long, "en", "b", 1), (5, long, None, None, None), (4, prose(2, 90), "x", "b", 7), (None, prose(3, 90), "en", "c", 3), (6, prose(900, 40), "en", "c", 3), (7, prose(4, 60) + "\n" + prose(5, 60), "en", "b", 3), (8, prose(6, 9) + "\n" + prose(5, 60), "en", "b", 3)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("rid", "id", "node", "c0", "row", "size", "score", "stretch", "_held", "component_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, tables, stage):
    run, docs = dict(corpus_pipeline.STAGES)[stage], odd(spark)
    out = run(spark, docs, tables)
    rows = out.collect()
    if stage != "mixture":
        assert out.columns == docs.columns
    have = [(r.doc_id, r.text) for r in rows] if stage != "mixture" else []
    if stage == "line_dedup":
        assert len(rows) == 11 and (5, docs.where("doc_id = 5").first().text) not in have and (8, prose(6, 9)) in have
    if stage == "near_copies":
        assert sorted(i for i, _ in have if i is not None) == [1, 2, 3, 4, 4, 4, 6, 7, 8] and sum(i is None for i, _ in have) == 2
    if stage == "decontamination":
        assert len(rows) == 11 and 6 not in {i for i, _ in have}
    if stage == "mixture":
        assert all(0 < r.copies <= 2 and r.taken == r.copies * r.size for r in rows)
    assert run(spark, docs.where("false"), tables).count() == 0


def test_run_equals_its_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tables)
    key = lambda df: sorted((r.doc_id, r.copies, r.taken) for r in df.collect())
    assert key(corpus_pipeline.run(spark, tables)) == key(docs)


def test_components_of_few_links_take_one_task(spark, monkeypatch):
    """Paths, stars, rings and chance links: no step is run for them, and the steps give the same."""
    draw = random.Random(5)
    chain = draw.sample(range(1000, 1300), 300)
    links = list(zip(chain, chain[1:], strict=False)) + [(5000, x) for x in range(4000, 4100)] + [(6000 + i, 6000 + (i + 1) % 50) for i in range(50)]
    links += [(draw.randrange(7000, 7400), draw.randrange(7000, 7400)) for _ in range(220)] + [(-(1 << 62), 1 << 62), (9, 9), (None, 3), (8, None), (6000, 6001)]
    least: dict[int, int] = {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = least.setdefault(a, a), least.setdefault(b, b)
            least |= {k: min(x, y) for k, v in least.items() if v in (x, y)}
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    monkeypatch.setattr(_components, "HELD", 0, raising=False)
    assert sorted(map(tuple, _components.connected_components(df).collect())) == sorted(least.items())
    monkeypatch.undo()
    monkeypatch.setattr(_components, "_steps", None)
    assert sorted(map(tuple, _components.connected_components(df).collect())) == sorted(least.items())
    assert _components.connected_components(df.where("a is null")).count() == 0
