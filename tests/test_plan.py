"""Whole plans, sources, rules, streams."""

import io
import json
import zipfile
from datetime import datetime

import pytest

from cleanloom.operators.rules import RuleMemory, embed
from cleanloom.plans.pipeline import CleaningPipeline
from cleanloom.sources import demo_accounts, read_any, write_csv, write_excel, xlsx
from cleanloom.streaming import clean_rows

PEOPLE = [("Ida", 31.0, "£41,500", "2021-03-04"), ("Ida", 31.0, "£41,500", "2021-03-04"), ("Jo", 66.0, "?", "soon"), ("Kim", None, "£39,250", "2022-11-30"), ("Lu", 44.0, "(1,200)", "2020-07-09")]


def people(spark):
    return spark.createDataFrame(PEOPLE, "`Full Name` string, age double, salary string, signup_date string").coalesce(1)


def test_pipeline(spark):
    out, summary = CleaningPipeline(errors="raise").run(people(spark))
    assert out.count() == 4 and "full_name" in out.columns and not summary["failed_steps"]
    assert out.where("salary is null").count() == 0 and dict(out.dtypes)["salary"] == "double"
    json.dumps(summary)


def test_pipeline_with_rule(spark, tmp_path):
    rules = RuleMemory(spark, str(tmp_path))
    rules.add_rule("salary", "has_missing_values", "imputation", "constant")
    out, summary = CleaningPipeline(rules=rules, errors="raise").run(people(spark))
    assert summary["metrics"]["rules_retrieved"] > 0 and out.where("salary is null").count() == 0


def test_rules(spark, tmp_path):
    rules = RuleMemory(spark, str(tmp_path))
    assert len(rules.get_all_rules()) == 3
    with pytest.raises(ValueError):
        rules.add_rule("x", "y", "imputation", "magic")
    assert [r["column_pattern"] for r in rules.query_relevant_rules(["zip"], [], "salary income price", k=1)] == [".*", "salary|income|price|revenue|amount"]
    impute, tokens, _ = rules.resolve_pipeline_overrides(["age"], [])
    assert impute == {"age": "median"} and tokens == sorted(tokens)
    rules.reset_store()
    assert rules.get_all_rules() == []
    (tmp_path / "rules.jsonl").write_text("broken")
    assert rules.get_all_rules() == [] and embed("a b") == embed("b a")


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,N/A\n2,b\n")
    assert [tuple(r) for r in read_any(spark, str(tmp_path / "a.csv")).collect()] == [(1, None), (2, "b")]
    (tmp_path / "b.json").write_text('{"x": {"0": 1, "1": 2}, "y": {"0": "p", "1": "q"}}')
    assert sorted(tuple(r) for r in read_any(spark, str(tmp_path / "b.json")).collect()) == [(1, "p"), (2, "q")]
    write_csv(demo_accounts(spark), str(tmp_path / "out"), single_file=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 6
    with pytest.raises(Exception, match="no reader"):
        read_any(spark, "x.odd")


def test_excel(spark, tmp_path):
    """A round trip, and a workbook as other programs write it: shared texts, own date formats, gaps, columns of several kinds."""
    rows = [(1, "a<b & c", 2.5, True, datetime(2024, 2, 29, 13, 30)), (None, " kept ", -1e-7, None, None), (3, None, None, False, datetime(1999, 12, 31))]
    df = spark.createDataFrame(rows, "`n 1` long, t string, x double, b boolean, at timestamp_ntz").coalesce(1)
    write_excel(df, path := str(tmp_path / "book.xlsx"))
    back = read_any(spark, path)
    assert back.dtypes == df.dtypes and [tuple(r) for r in back.collect()] == rows
    sheet = f'<worksheet xmlns="{xlsx.MAIN}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2" s="1"><v>45351.5</v></c><c r="C2"><v>7</v></c></row><row r="3"><c r="C3" t="str"><v>x</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{xlsx.MAIN}" xmlns:r="{xlsx.OFFICE}"><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{xlsx.PACKAGE}/relationships"><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{xlsx.MAIN}"><si><t>day</t></si><si><r><t>wh</t></r><r><t>at</t></r></si></sst>')
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{xlsx.MAIN}"><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/s.xml", sheet)
    (tmp_path / "other.xlsx").write_bytes(data.getvalue())
    other = read_any(spark, str(tmp_path / "other.xlsx"))
    assert other.columns == ["day", "column_2", "what"] and [tuple(r) for r in other.collect()] == [(datetime(2024, 2, 29, 12), None, "7"), (None, None, "x")]
    with pytest.raises(Exception, match="sheet holds"):
        write_excel(df, path, max_rows=2)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(" a  b ", 5.0), ("n/a", 500.0)], "t string, v double").write.parquet(str(tmp_path / "in"))
    stream = clean_rows(spark.readStream.schema("t string, v double").parquet(str(tmp_path / "in")), fences={"v": (0, 100)})
    query = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.t or "", r.v) for r in spark.table("cleaned").collect()) == [("", 100.0), ("a b", 5.0)]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
