"""The corpus pipeline on a small corpus: what is planted goes, what is clean stays."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def text(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 5))) for _ in range(n))


def test_pipeline(spark, tmp_path):
    item = text(777, 40)
    docs = {i: text(i, 120) for i in range(150)}
    docs |= {i: " | ".join(text(i, 60).upper().split()) for i in range(200, 360)}
    docs |= {400: docs[1], 401: docs[2].replace(docs[2].split()[5], "zzz", 1), 402: f"{text(5000, 40)} {item}"}
    labels = [(i, int(i < 200), 0) for i in [*range(150), *range(200, 360)]]
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in seen.select("doc_id").collect()}
        assert name == "mixture" or seen.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert len(kept["quality"] & set(range(200, 360))) <= 8 and len(kept["quality"] & set(range(150))) >= 147
    assert 400 not in kept["line_dedup"] and 401 not in kept["near_copies"] and 402 in kept["near_copies"]
    assert kept["decontamination"] == kept["near_copies"] - {402}
    assert kept["mixture"] <= kept["decontamination"]
