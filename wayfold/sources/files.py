"""Files in and out: JSON lines, trip CSV, metric CSV, YAML and GraphML settings, debug rows."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import finished

TRIP_COLUMNS = ("TRIP_ID", "TAXI_ID", "TIMESTAMP", "MISSING_DATA", "POLYLINE")
#: Names that a report must not carry (fixed values).
PRIVATE = (
    "traj_id", "taxi_id", "user_id", "sbs_id", "sbs_index", "num_sbs", "true_v", "v", "risk_score", "risk_endpoint", "risk_stay", "risk_degree",
    "target_bucket", "exec_bucket", "epsilon_event", "epsilon_bucket", "t", "global_pos", "delta_t", "feasible_buckets",
)
#: Headers of metric tables and the names they are given (fixed values).
METRIC_NAMES = {
    "Density Error": "dens_err", "density error": "dens_err", "Dens-Err": "dens_err",
    "Query Error": "query_err", "query error": "query_err", "Query-Err": "query_err",
    "HQ Error": "hq_err", "HQ-Err": "hq_err",
    "Trip Error": "trip_err", "trip error": "trip_err", "Trip-Err": "trip_err",
    "Length Error": "len_err", "length error": "len_err", "Len-Err": "len_err",
    "Diameter Error": "diam_err", "diameter error": "diam_err", "Diam-Err": "diam_err",
    "Pattern F1": "pattern_f1", "Pattern-F1": "pattern_f1",
}
REQUIRED_METRICS = ("dens_err", "query_err", "trip_err", "len_err", "diam_err", "pattern_f1")
DATASETS = ("porto", "oldenburg", "chengdu")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file; a malformed line fails the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_trips(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The raw trip columns as strings, whatever the length of a field; quotes inside a field are doubled."""
    schema = ", ".join(f"{c} string" for c in TRIP_COLUMNS)
    rows = spark.read.csv(path, header=True, escape='"', maxCharsPerColumn=-1, enforceSchema=False, schema=schema)
    return rows.select(*TRIP_COLUMNS)


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """Columns of a CSV with a header, as strings or the types given; Spark reads it in splits, so it needs no chunks."""
    rows = spark.read.csv(path, header=True, escape='"')
    if columns:
        rows = rows.select(*(f"`{c}`" for c in columns))
    return rows.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in (types or {}).items()})


def matching_files(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that the glob patterns match, each once, in order; a pattern that matches nothing fails."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out: dict[str, None] = {}
    for pattern in patterns:
        path = hadoop(pattern)
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        names = sorted(str(x.getPath()) for x in (found or []))
        if not names:
            raise FileNotFoundError(pattern)
        out |= dict.fromkeys(names)
    return list(out)


def method_name(method: Column) -> Column:
    """A method's one name, whatever its spelling."""
    plain = F.translate(F.lower(F.trim(method)), "- ", "__")
    return F.when(plain.rlike("^([a-z]+_)?riskaware$"), "riskaware").when(plain.rlike("^([a-z]+_)?uniform$"), "uniform").when(F.trim(method) != "", F.trim(method))


def read_metrics(spark: SparkSession, paths: list[str], renames: dict[str, str] | None = None) -> DataFrame:
    """Metric CSVs as one table with source_csv.

    Headers get the names of METRIC_NAMES and of renames; dataset is
    dataset_name; seed, profile and dataset_name come from the path where a
    column lacks them; methods get their one name. A mark of byte order is no
    part of the first header. A file that two patterns match is read once.
    """
    out: DataFrame | None = None
    for path in matching_files(spark, paths):
        part = spark.read.csv(path, header=True, encoding="UTF-8")
        part = part.toDF(*(c.lstrip("\ufeff").strip() for c in part.columns)).withColumn("source_csv", F.input_file_name())
        part = part.withColumnsRenamed(METRIC_NAMES | {"dataset": "dataset_name"} | (renames or {}))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    low = F.lower("source_csv")
    seed = F.nullif(F.regexp_extract(low, r"seed[_-]?(\d+)", 1), F.lit(""))
    profile = F.nullif(F.upper(F.regexp_extract(low, r"\b(b\d+)p\d+\b", 1)), F.lit(""))
    profile = F.concat(profile, F.lit("p"), F.regexp_extract(low, r"\bb\d+p(\d+)\b", 1))
    dataset = F.nullif(F.regexp_extract(low, f"({'|'.join(DATASETS)})", 1), F.lit(""))
    have = lambda c: F.nullif(F.col(c), F.lit("")) if c in out.columns else F.lit(None).cast("string")
    made = {"seed": F.coalesce(have("seed"), seed).cast("int"), "profile": F.coalesce(have("profile"), profile), "dataset_name": F.coalesce(have("dataset_name"), dataset)}
    if "method" in out.columns:
        made["method"] = method_name(F.col("method"))
    return out.withColumns(made)


def missing_metrics(rows: DataFrame, required: tuple[str, ...] = REQUIRED_METRICS) -> list[str]:
    """The metrics of `required` that the table has no column for."""
    return [c for c in required if c not in rows.columns]


def read_json(path: str) -> dict:
    """A JSON document, such as a summary; for rows there is read_jsonl()."""
    import json

    return json.loads(Path(path).read_text(encoding="utf-8"))


def write_json(values: dict, path: str) -> None:
    """A JSON document, written whole or not at all."""
    import json
    import os

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = Path(f"{path}.part")
    part.write_text(json.dumps(values, indent=2, ensure_ascii=False, sort_keys=True), encoding="utf-8")
    os.replace(part, path)


def resolved(path: str | None, root: str) -> str | None:
    """A relative path as one below root; absolute ones, and those with a scheme, stay."""
    if path is None or path.startswith("/") or "://" in path:
        return path
    return f"{root.rstrip('/')}/{path}"


def read_recovered(spark: SparkSession, path: str) -> DataFrame:
    """A stored distribution (value or u and v, prob), scaled so that each context sums to 1; what is not positive goes."""
    rows = spark.read.parquet(path).where("prob > 0")
    by = [c for c in ("split", "u") if c in rows.columns]
    return rows.withColumn("prob", F.col("prob") / F.sum("prob").over(Window.partitionBy(*by)))


def write_csv(parts: list[DataFrame], path: str, columns: list[str] | None = None) -> None:
    """One CSV of tables that may differ in columns: the header is their union, first seen first, or `columns`."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    (out.select(*columns) if columns else out).write.mode("overwrite").csv(path, header=True)


def write_debug(df: DataFrame, path: str | None) -> None:
    """Private rows, only where a path is given."""
    if path:
        df.write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: str, progress: str | None = None) -> DataFrame:
    """Append the rows whose key is not there yet, so that an interrupted run goes on where it stopped.

    progress names a JSON document that tells how many rows are there. One
    writer at a time: two that run together may each append the same key.
    """
    spark = df.sparkSession
    known = spark.read.parquet(path).select(key) if finished(spark, path) else None
    (df if known is None else df.join(known, key, "left_anti")).write.mode("append").parquet(path)
    out = spark.read.parquet(path)
    if progress:
        write_json({"path": path, "key": key, "rows": out.count()}, progress)
    return out


def check_report(df: DataFrame) -> DataFrame:
    """df, unless it has a column that a server must not see."""
    bad = sorted(set(df.columns) & set(PRIVATE))
    if bad:
        raise ValueError(f"a report must not hold {', '.join(bad)}")
    return df


def read_yaml(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def write_yaml(values: dict, path: str) -> None:
    import yaml

    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(yaml.safe_dump(values, sort_keys=True))


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (node, lon, lat) and roads (src, dst, key, length) of a GraphML multigraph; nothing is downloaded."""
    root = ET.parse(path).getroot()
    ns = root.tag[: root.tag.index("}") + 1] if "}" in root.tag else ""
    names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
    data = lambda x: {names.get(d.get("key"), d.get("key")): d.text for d in x.findall(f"{ns}data")}
    nodes = [(n.get("id"), float(d["x"]), float(d["y"])) for n in root.iter(f"{ns}node") if "x" in (d := data(n))]
    roads, seen = [], {}
    for e in root.iter(f"{ns}edge"):
        pair = (e.get("source"), e.get("target"))
        key = int(e.get("id")) if (e.get("id") or "").isdigit() else seen.get(pair, 0)
        seen[pair] = seen.get(pair, 0) + 1
        length = data(e).get("length")
        roads.append((*pair, key, float(length) if length else None))
    return spark.createDataFrame(nodes, "node string, lon double, lat double"), spark.createDataFrame(roads, "src string, dst string, key int, length double")
