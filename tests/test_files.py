"""R9 file sources: Parquet / CSV / JSON in with explicit schemas, pushdown."""

import tempfile

import pytest

from furrow.operators.incremental import merge_partitions, write_partitions
from furrow.sources.bulk import read_bulk, write_bulk
from furrow.sources.tables import load, read_files, read_with_rejects, register_views

SF = "/root/testdata/sf0.001"


def test_csv_and_json_round_trip(spark):
    part = load(spark, SF, "part")
    root = tempfile.mkdtemp(prefix="furrow-files-")
    part.write.option("header", True).csv(f"{root}/csv")
    part.write.json(f"{root}/json")
    schema = part.schema
    csv = read_files(spark, f"{root}/csv", "csv", schema=schema, header=True)
    js = read_files(spark, f"{root}/json", "json", schema=schema)
    assert csv.exceptAll(part).count() == 0 and part.exceptAll(csv).count() == 0
    assert js.exceptAll(part).count() == 0 and part.exceptAll(js).count() == 0


def test_text_formats_need_schema(spark):
    with pytest.raises(ValueError):
        read_files(spark, "/nowhere", "csv")


def test_parquet_pushdown_and_pruning(spark):
    df = read_files(spark, f"{SF}/documents.parquet").select("doc_id", "n_chars").where("n_chars > 1000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,1000)]" in plan
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in plan


def test_register_views(spark):
    names = register_views(spark, SF)
    assert "lineitem" in names and spark.sql("SELECT count(*) FROM region").first()[0] == 5


def test_bad_records_are_rejected_whatever_is_selected(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x,2.50\n2,y\nthree,z,1.00\n4,w,9.99,more\n,,\n")
    (tmp_path / "b.json").write_text('{"k": 1, "n": "x", "v": 2.5}\n{"k": "two", "n": "y"}\n{"k": 3\nnonsense\n{"k": 4, "extra": true}\n\n')
    schema = "k int, n string, v decimal(6,2)"
    for fmt, file, keys, bad in (("csv", "a.csv", [1, None], ["2,y", "three,z,1.00", "4,w,9.99,more"]),
                                 ("json", "b.json", [1, 4], ['{"k": "two", "n": "y"}', '{"k": 3', "nonsense"])):
        rows, rejects = read_with_rejects(spark, str(tmp_path / file), fmt, schema)
        assert rows.columns == ["k", "n", "v"]
        assert sorted((r.k for r in rows.select("k").collect()), key=str) == sorted(keys, key=str)
        assert rows.count() == len(keys) and rejects.count() == len(bad)
        assert sorted(r.record for r in rejects.select("record").collect()) == sorted(bad)
        assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {file}
        assert [r.parsed.n for r in rejects.where("record LIKE '%y%'").collect()] == ["y"]
    with pytest.raises(ValueError):
        read_with_rejects(spark, "/nowhere", "parquet", schema)


def test_views_of_tables_that_are_there(spark, tmp_path):
    load(spark, SF, "region").write.parquet(str(tmp_path / "region.parquet"))
    assert register_views(spark, str(tmp_path)) == ["region"] and register_views(spark, f"file://{tmp_path}") == ["region"]


def test_bulk_files(spark, tmp_path):
    import datetime as dt
    import json
    import os
    rows = [(1, "a\nb \"c\" }\n{", dt.datetime(2024, 1, 2, 3, 4, 5, 678000), 1.5), (2, None, None, None), (3, "ß€😀", dt.datetime(1999, 12, 31), -0.25)]
    df = spark.createDataFrame(rows * 4, "id int, text string, at timestamp_ntz, v double").coalesce(1)
    path = str(tmp_path / "bulk")
    assert write_bulk(df, path, "things", 5) == 12
    files = [f for f in os.listdir(path) if f.startswith("part-")]
    assert len(files) == 3  # of five rows at most
    lines = [json.loads(x) for f in files for x in open(os.path.join(path, f), encoding="utf-8") if x.strip()]
    assert len(lines) == 24 and lines[0] == {"index": {"_index": "things"}}
    assert {"id": 1, "text": rows[0][1], "at": "2024-01-02T03:04:05.678000", "v": 1.5} in lines and {"id": 2} in lines
    back = read_bulk(spark, path, df.schema, "things")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows * 4, key=str)
    assert read_bulk(spark, path, df.schema, "others").count() == 0


def test_only_changed_partitions_are_rewritten(spark, tmp_path):
    import glob
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(i, i % 4, f"v{i}") for i in range(40)] + [(100, None, "null part")], "id int, part int, v string")
    write_partitions(df, path, ["part"])

    def files():
        return {f for f in glob.glob(f"{path}/*/*.parquet")}

    before = files()
    changes = spark.createDataFrame([(2, 2, "new"), (50, 2, "added"), (100, None, "still null")], "id int, part int, v string")
    for _ in range(2):  # again changes nothing
        merge_partitions(path, changes, ["id"], ["part"])
        got = {r.id: (r.part, r.v) for r in spark.read.schema(df.schema).parquet(path).collect()}
        assert len(got) == 42 and got[2] == (2, "new") and got[50] == (2, "added") and got[100] == (None, "still null") and got[6] == (2, "v6")
    kept = before & files()
    assert {f.split("/")[-2] for f in kept} == {"part=0", "part=1", "part=3"}
    fresh = str(tmp_path / "new")
    merge_partitions(fresh, changes, ["id"], ["part"])
    assert spark.read.parquet(fresh).count() == 3
