import json

import pytest

from millrace.sources import files


def test_csv_rows(spark, tmp_path):
    for name, rows in (("batch_1.csv", 'a,b\n1,"x\ny"\n2,\n'), ("batch_2.csv", "a,b\n3,z\n")):
        (tmp_path / name).write_text(rows)
    got = files.read_csv(spark, str(tmp_path / "batch_*.csv")).collect()
    assert sorted((r.file, r.row, r.a, r.b) for r in got) == [("batch_1.csv", 2, "1", "x\ny"), ("batch_1.csv", 3, "2", ""), ("batch_2.csv", 2, "3", "z")]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a": 3')
    assert sorted(r.a for r in files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json_lines(spark, str(tmp_path / "x.jsonl"), "a int", strict=True).collect()


def test_manifest(spark, tmp_path):
    good = {"toy": True, "catalog": [{"image": "i", "part_id": "p", "category": "c", "verified": True}], "queries": {"test": [{"image": "q", "part_id": "p"}]}}
    bad = [{**good, "catalog": []}, {**good, "queries": {"test": [{"image": "q", "part_id": "z"}]}}, {**good, "catalog": [{**good["catalog"][0], "verified": False}]}]
    for k, m in enumerate([good, *bad]):
        (tmp_path / f"{k}.json").write_text(json.dumps(m, indent=1))
    catalog, queries = files.read_manifest(spark, str(tmp_path / "0.json"), "test")
    assert catalog.count() == queries.count() == 1
    for k in (1, 2, 3):
        with pytest.raises(ValueError):
            files.read_manifest(spark, str(tmp_path / f"{k}.json"), "test")


def test_images_and_results(spark, tmp_path):
    for p in ("s1/train/p1/a.jpg", "s1/valid/p1/b.png", "s2/p2/c.jpg", "s2/p2/note.txt"):
        (tmp_path / "img" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / p).write_bytes(b"x")
    got = files.list_images(spark, str(tmp_path / "img")).collect()
    assert sorted((r.source, r.part) for r in got) == [("s1", "p1"), ("s1", "p1"), ("s2", "p2")]
    df = spark.range(3)
    path = files.write_result(df, str(tmp_path / "results"), {"b": 1, "a": 2})
    assert path.endswith(files.config_hash({"a": 2, "b": 1})) and spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_result(df, str(tmp_path / "results"), {"b": 1, "a": 2})
    (tmp_path / "runs/r1").mkdir(parents=True)
    (tmp_path / "runs/r1/metrics.json").write_text('{"map": 0.5}')
    assert files.read_runs(spark, str(tmp_path / "runs")).select("run", "map").first() == ("r1", 0.5)
    assert files.union_seeds({1: df, 2: df}).groupBy("seed").count().count() == 2
