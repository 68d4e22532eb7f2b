"""Readers and writers of the catalogue's files."""

from __future__ import annotations

import hashlib
import json
import platform
import subprocess
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.functions.dictionaries import BRANDS
from millrace.functions.imaging import CROP_PADDING, REGIONS
from millrace.storage import exists, read_text, write_text


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Rows of strings, missing ones empty, with ``file`` and ``row`` (from 2, as the header is the first)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns])).option("enforceSchema", False)
    df = reader.csv(path)
    # A file of rows that may span lines is read by one task, so ids rise in its order.
    from pyspark.sql import Window

    df = df.fillna("").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).withColumn("__i", F.monotonically_increasing_id())
    return df.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("__i")) + 1).drop("__i")


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; lines that can't be read are skipped, or fail the read if `strict`."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


MANIFEST = "toy boolean, catalog array<struct<image:string,part_id:string,category:string,verified:boolean>>, queries map<string,array<struct<image:string,part_id:string>>>"


def read_manifest(spark: SparkSession, path: str, split: str) -> tuple[DataFrame, DataFrame]:
    """Catalogue and queries of a split; refuses unverified rows, empty sides and queries without a part in the catalogue."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    catalog = m.select(F.explode("catalog").alias("c")).select("c.*")
    queries = m.select(F.explode(F.coalesce(F.try_element_at("queries", F.lit(split)), F.expr("array()"))).alias("q")).select("q.*")
    if catalog.where("verified = false").take(1):
        raise ValueError("the manifest has unverified rows")
    if not catalog.take(1) or not queries.take(1):
        raise ValueError("a side of the manifest is empty")
    if queries.join(catalog, "part_id", "left_anti").take(1):
        raise ValueError("a query has no part in the catalogue")
    return catalog, queries


def list_images(spark: SparkSession, root: str, pattern: str = "*.{jpg,jpeg,png,webp}", sample: int | None = None, seed: int = 42) -> DataFrame:
    """``(path, source, part, length)`` of images at any depth: source is the top folder, part the one they are in. `sample`: so
    many drawn ones at most."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")
    rest = F.split(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^/*{root.strip('/')}/", ""), "/")
    df = df.select("path", F.element_at(rest, 1).alias("source"), F.element_at(F.split("path", "/"), -2).alias("part"), "length")
    return df if sample is None else df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "path")), "path").limit(sample)


def part_images(images: DataFrame) -> DataFrame:
    """``(source, part, n, paths)``: folders of one name below one source, at whatever depth, are one part."""
    return images.groupBy("source", "part").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("path")).alias("paths"))


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Metrics of all result folders, with the folder's name."""
    return spark.read.option("multiLine", True).json(f"{root}/*/metrics.json").withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def union_seeds(frames: dict[int, DataFrame]) -> DataFrame:
    out = None
    for seed, df in frames.items():
        df = df.withColumn("seed", F.lit(seed))
        out = df if out is None else out.unionByName(df)
    return out


def read_config(spark: SparkSession, path: str, split: str | None = None) -> dict:
    """A configuration (YAML), with its split manifest replaced by `split` if given, and the manifest's checksum in it."""
    import yaml

    config = yaml.safe_load(read_text(spark, path))
    if split:
        config["data"]["split_manifest"] = split
    manifest = config["data"]["split_manifest"]
    if not exists(spark, manifest):
        raise FileNotFoundError(f"no split manifest at {manifest}")
    config["data"]["split_sha256"] = spark.read.format("binaryFile").load(manifest).select(F.sha2("content", 256)).first()[0]
    return config


def config_faults(config: dict) -> list[str]:
    """What would make a run measure something else than it says; a run refuses a configuration with any."""
    index, query, out = config["index"], config["query"], []
    checks = (
        (config["data"]["eval_split"] == "test", "the test split is sealed"),
        (index["backend"] != "qdrant", f"unsupported index backend: {index['backend']}"),
        (index.get("exact") is not True, "an index that isn't exact understates recall"),
        (index["metric"] != "cosine", f"unsupported metric: {index['metric']}"),
        (config["embed"]["backend"] != "service", f"unsupported embed backend: {config['embed']['backend']}"),
        (config["eval"]["pool_images_to_part"] != "max", "images are pooled to parts by their maximum only"),
        (query["region"] not in REGIONS, f"query region must be one of {', '.join(REGIONS)}"),
        (query["region"] in CROP_PADDING and not (query.get("detector") or {}).get("model"), f"query region {query['region']} needs a detector"),
        (not isinstance(query.get("preprocess"), bool), "query preprocess must be true or false"),
        *((bool(query.get(flag)), f"query {flag} isn't implemented") for flag in ("use_ocr", "use_metadata", "use_fusion")),
    )
    for fault, text in checks:
        if fault:
            out.append(text)
    return out


def read_brands(spark: SparkSession, path: str | None) -> dict[str, list[str]]:
    """Brands with their spellings from a JSON file, in its order; the defaults if there is no file or it can't be read."""
    text = read_text(spark, path) if path else None
    try:
        return dict(BRANDS) if text is None else json.loads(text)
    except ValueError:
        return dict(BRANDS)


def write_brands(spark: SparkSession, path: str, brands: dict[str, list[str]]) -> None:
    write_text(spark, path, json.dumps(brands, indent=2, ensure_ascii=False))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame | None:
    """``label`` of a taxonomy (a JSON list of objects); None, so that categories aren't checked, if there is no file."""
    if not exists(spark, path):
        return None
    return spark.read.schema("label string").option("multiLine", True).json(path).where("label is not null").distinct()


def read_product_pages(spark: SparkSession, fetch: Callable[[int, int], list[dict]], schema: str, limit: int = 100, most: int = 1_000_000) -> DataFrame:
    """Rows of a paged source: ``fetch(skip, limit)`` gives a page, an empty one ends it. Pages are landed one by one, so the
    driver holds one; pages without images are read past."""
    out = spark.createDataFrame([], schema)
    for skip in range(0, most, limit):
        page = fetch(skip, limit)
        if not page:
            return out
        fields = out.schema.fieldNames()
        out = out.unionByName(spark.createDataFrame([tuple(row.get(f) for f in fields) for row in page], schema))
    raise ValueError(f"more than {most} products")


def config_hash(config: dict) -> str:
    """First 12 hex digits of the sha256 of the configuration with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def code_version(folder: str = ".") -> str:
    """The checked-out commit, with "-dirty" if files differ from it; "unknown" outside a repository."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    head, changed = git("rev-parse", "HEAD"), git("status", "--porcelain")
    if head.returncode or changed.returncode:
        return "unknown"
    return head.stdout.strip() + ("-dirty" if changed.stdout.strip() else "")


def environment(spark: SparkSession) -> dict[str, str]:
    import numpy

    return {"python": sys.version, "platform": platform.platform(), "numpy": numpy.__version__, "spark": spark.version, "java": spark._jvm.System.getProperty("java.version")}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """The one row of a report as a JSON file."""
    rows = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("r")).take(2)
    if len(rows) != 1:
        raise ValueError("a report is one row")
    write_text(df.sparkSession, path, json.dumps(json.loads(rows[0].r), indent=2) + "\n")


def write_result(df: DataFrame, root: str, config: dict) -> str:
    """A result under its configuration's hash; refuses to write over one."""
    path = f"{root}/{config_hash(config)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_run(per_query: DataFrame, metrics: dict, root: str, config: dict, code: str = ".") -> str:
    """A run under its configuration's hash: metrics, rows, configuration, code version and environment. Refuses to write over
    one; the metrics come last, so a run that has them is whole."""
    spark, path = per_query.sparkSession, f"{root}/{config_hash(config)}"
    if exists(spark, path):
        raise FileExistsError(f"{path} is there already")
    write_csv(per_query, f"{path}/per_query.csv")
    version = code_version(code)
    for name, text in (("config.json", json.dumps(config, indent=2)), ("git_sha", version), ("env.json", json.dumps(environment(spark), indent=2)), ("metrics.json", json.dumps({"config_hash": config_hash(config), "git_sha": version, **metrics}))):
        write_text(spark, f"{path}/{name}", text + "\n", overwrite=False)
    return path


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written first if there is none: for hashes of images and the like."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_manifest(rows: DataFrame, path: str) -> None:
    """Rows ``(side, image, part_id)`` as a folder a side."""
    rows.write.mode("overwrite").partitionBy("side").json(path)
