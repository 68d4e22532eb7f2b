import json

import pytest

from millrace.sources import files, labels
from millrace.storage import read_text


def dataset(root, names, layout, rows):
    root.mkdir(parents=True)
    (root / "data.yaml").write_text("names:\n" + ("".join(f"  {k}: {n}\n" for k, n in enumerate(names)) if layout == 1 else "".join(f"- {n}\n" for n in names)))
    for split, file, text in rows:
        folder = root / split / "labels" if layout == 1 else root / "labels" / split
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{file}.txt").write_text(text)


def test_merging_two_data_sets(spark, tmp_path):
    dataset(tmp_path / "a", ["hood", "Back-Door", "isimsiz"], 1, [("train", "x", "0 1 2 3 4\n\n1  5 6 7 8\n"), ("valid", "y", "2 0 0 0 0\n0 9 9 9 9\n")])
    dataset(tmp_path / "b", ["rear door", "New Part"], 2, [("test", "x", "1 .1 .2 .3 .4\n")])
    maps, known, rows = {}, ["front_bumper", "hood", "rear_door"], None
    for source in ("a", "b"):
        root = str(tmp_path / source)
        maps[source], known = labels.class_mapping(labels.class_names(spark, root), known)
        lines = labels.label_lines(spark, root, source)
        rows = lines if rows is None else rows.unionByName(lines)
    assert maps == {"a": {0: 1, 1: 2}, "b": {0: 2, 1: 3}} and known[3] == "new_part"
    out = labels.merged(rows, labels.mapping_table(spark, maps))
    got = sorted((r.split, r.file, r.class_id, r.box) for r in out.collect())
    assert got == [("train", "a_x", 1, "1 2 3 4"), ("train", "a_x", 2, "5 6 7 8"), ("val", "a_y", 1, "9 9 9 9"), ("val", "b_x", 3, ".1 .2 .3 .4")]
    labels.write_labels(out, known, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out/labels/split=train/file=a_x")).collect()) == ["1 1 2 3 4", "2 5 6 7 8"]
    assert labels.class_names(spark, str(tmp_path / "out")) == known
    assert labels.class_names(spark, str(tmp_path / "nothing")) == [] and labels.label_lines(spark, str(tmp_path / "nothing"), "z").collect() == []
    assert sorted(r.class_id for r in labels.offset_classes(out, 10).collect()) == [11, 11, 12, 13]


def test_spellings():
    assert [labels.spelled(x) for x in ("Brake-Pad", " brake disc ", "D008", "front glass", "odd")] == ["brake_pad", "brake_rotor", None, "front_windshield", "odd"]


def test_configuration(spark, tmp_path):
    manifest = tmp_path / "m.json"
    manifest.write_text("{}")
    (tmp_path / "c.yaml").write_text(f"name: n\ndata: {{split_manifest: none, eval_split: valid}}\nindex: {{backend: qdrant, exact: true, metric: cosine}}\nembed: {{backend: service}}\neval: {{pool_images_to_part: max}}\nquery: {{region: crop_15, preprocess: true, detector: {{model: m}}}}\n")
    config = files.read_config(spark, str(tmp_path / "c.yaml"), str(manifest))
    assert config["data"]["split_sha256"] == "44136fa355b3678a1146ad16f7e8649e94fb4fc21fe77e8310c060f61caaff8a" and files.config_faults(config) == []
    with pytest.raises(FileNotFoundError):
        files.read_config(spark, str(tmp_path / "c.yaml"))
    bad = json.loads(json.dumps(config))
    bad["data"]["eval_split"], bad["index"]["exact"], bad["query"] = "test", "yes", {"region": "crop_15", "use_ocr": True}
    assert len(files.config_faults(bad)) == 5


def test_runs_reports_and_dictionaries(spark, tmp_path):
    root, config = str(tmp_path / "results"), {"a": 1}
    path = files.write_run(spark.range(3), {"name": "run", "value": 0.5}, root, config, str(tmp_path))
    got = json.loads(read_text(spark, f"{path}/metrics.json"))
    assert got["name"] == "run" and got["git_sha"] == "unknown" and got["config_hash"] == files.config_hash(config)
    assert spark.read.option("header", True).csv(f"{path}/per_query.csv").count() == 3 and json.loads(read_text(spark, f"{path}/config.json")) == config
    assert [r.run for r in files.read_runs(spark, root).collect()] == [files.config_hash(config)]
    with pytest.raises(FileExistsError):
        files.write_run(spark.range(3), {}, root, config)
    files.write_report(spark.sql("SELECT 1 AS a, CAST(NULL AS INT) AS b, 'x' AS c"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1, "b": None, "c": "x"}
    with pytest.raises(ValueError):
        files.write_report(spark.range(2), str(tmp_path / "r2.json"))
    files.write_brands(spark, str(tmp_path / "b.json"), {"Zed": ["zed"], "Ab": ["ab", "a b"]})
    assert list(files.read_brands(spark, str(tmp_path / "b.json"))) == ["Zed", "Ab"]
    (tmp_path / "broken.json").write_text("{")
    assert files.read_brands(spark, str(tmp_path / "broken.json")) == files.read_brands(spark, None) == files.read_brands(spark, str(tmp_path / "no.json"))
    (tmp_path / "t.json").write_text('[{"label": "x", "id": 1}, {"label": "y"}, {"label": "x"}]')
    assert sorted(r.label for r in files.read_taxonomy(spark, str(tmp_path / "t.json")).collect()) == ["x", "y"]
    assert files.read_taxonomy(spark, str(tmp_path / "no.json")) is None
    made = []
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), lambda: made.append(1) or spark.range(4)).count() == 4
    assert made == [1]


def test_pages_and_part_images(spark, tmp_path):
    rows = [{"product_id": k, "image_url": None if 3 <= k < 6 else "u"} for k in range(8)]
    df = files.read_product_pages(spark, lambda skip, limit: rows[skip : skip + limit], "product_id long, image_url string", limit=3)
    assert df.count() == 8  # a page without images doesn't end the scan
    for p in ("s/train/p1/b.jpg", "s/valid/p1/a.jpg", "t/p2/c.jpg"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    images = files.list_images(spark, str(tmp_path))
    assert sorted((r.source, r.part, r.n) for r in files.part_images(images).collect()) == [("s", "p1", 2), ("t", "p2", 1)]
    some = files.list_images(spark, str(tmp_path), sample=2)
    assert some.count() == 2 and sorted(some.collect()) == sorted(files.list_images(spark, str(tmp_path), sample=2).collect())
