"""Readers and writers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyphony.functions.text import strip


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table of a folder, only the named columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def prompt_pool(spark: SparkSession, pattern: str) -> DataFrame:
    """All prompt files of a glob as one table, ``dataset`` = file name without ending; human_responses may be missing."""
    df = spark.read.option("mergeSchema", "true").parquet(pattern)
    df = df.withColumn("dataset", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    if "human_responses" not in df.columns:
        df = df.withColumn("human_responses", F.lit(None).cast("array<string>"))
    return df


def merged_counts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The per-model files of a folder as one table, and the rows of each model."""
    df = spark.read.option("mergeSchema", "true").parquet(folder)
    return df, df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """id, model (slug), family, gpus from a registry file: YAML list of entries, or JSON {name: slug or {slug, family}}.

    An entry without a family is of 'Other'; a file without entries is an error."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())
    rows: list[dict] = []
    if path.endswith(".json"):
        for k, v in json.loads(text or "{}").items():
            v = {"slug": v} if isinstance(v, str) else v
            rows.append({"id": k, "slug": v.get("slug", k), "family": v.get("family"), "gpus": v.get("gpus")})
    else:
        for line in text.splitlines():
            if re.match(r"\s*#", line) or not (m := re.match(r"\s*(-\s+)?([\w-]+)\s*:\s*(.*?)\s*(?:\s#.*)?$", line)):
                continue
            if m[1]:
                rows.append({})
            if rows and m[3]:
                rows[-1][m[2]] = m[3].strip("'\"")
        rows = [r for r in rows if "id" in r]
    if not rows:
        raise ValueError(f"no models in {path}")
    data = [(r["id"], (r.get("slug") or r["id"]).replace("/", "_"), r.get("family") or "Other", None if r.get("gpus") is None else str(r["gpus"])) for r in rows]
    return spark.createDataFrame(data, "id string, model string, family string, gpus string")


def self_hosted(models: DataFrame) -> DataFrame:
    """Entries that need accelerators; API models have none."""
    return models.where("gpus is not null")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """lang (file name without ending), line: non-blank lines."""
    df = spark.read.text(path).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("lang"), F.col("value").alias("line"))
    return df.where(strip(F.col("line")) != "")


def check_parallel(lines: DataFrame) -> None:
    """Every language must have the same number of lines."""
    n = lines.groupBy("lang").count().agg(F.min("count").alias("a"), F.max("count").alias("b")).first()
    if n.a != n.b:
        raise ValueError(f"languages have between {n.a} and {n.b} lines")


def fingerprint(spark: SparkSession, pattern: str) -> str:
    """SHA-256 over the names and contents of the files, in order of name; contents are hashed where they lie."""
    import hashlib

    files = spark.read.format("binaryFile").load(pattern)
    rows = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("h")).orderBy("name").collect()
    return hashlib.sha256("".join(f"{r['name']}\0{r['h']}\n" for r in rows).encode()).hexdigest()


def metric_sources(spark: SparkSession, pattern: str) -> DataFrame:
    """kind (intra, human_intra, inter), slug of files named kind__slug.parquet; an intra metric needs its human twin."""
    f = spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"/([^/]*__[^/]*)\.parquet(?:/[^/]*)?$", 1).alias("stem")).where("stem <> ''").distinct()
    f = f.select(F.split_part("stem", F.lit("__"), F.lit(1)).alias("kind"), F.split_part("stem", F.lit("__"), F.lit(2)).alias("slug"))
    return with_twin(f)


def with_twin(found: DataFrame) -> DataFrame:
    human = found.where("kind = 'human_intra'").select("slug")
    return found.where("kind = 'intra'").join(human, "slug", "left_semi").select("kind", "slug").union(found.where("kind <> 'intra'").select("kind", "slug"))


def write_vectors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("embed_slug", "model").parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """Write unless something is there."""
    df.write.mode("ignore").parquet(path)


def missing_keys(df: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are not there yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """resp_a, resp_b, sim from a wide CSV whose first column names the row."""
    wide = spark.read.option("header", "true").csv(path)
    first, *rest = wide.columns
    q = lambda c: f"`{c}`"
    return wide.unpivot([q(first)], [q(c) for c in rest], "resp_b", "sim").select(F.col(q(first)).alias("resp_a"), "resp_b", F.col("sim").cast("double").alias("sim"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def through_provider(df: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Inference and embedding connectors plug in here: a function over batches of pandas rows."""
    return df.mapInPandas(provider, schema)


def hashing_embedder(dim: int = 64, text: str = "text") -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """An offline embedder: signed character-trigram hashing to unit vectors, in column ``embedding``."""
    import zlib

    import numpy as np

    def run(batches):
        for pdf in batches:
            out = []
            for t in pdf[text].fillna(""):
                v = np.zeros(dim)
                for i in range(len(t) - 2):
                    h = zlib.crc32(t[i : i + 3].encode("utf-8", "surrogatepass"))
                    v[h % dim] += 1 if h >> 31 else -1
                n = np.linalg.norm(v)
                out.append((v / n if n else v).astype("float32").tolist())
            yield pdf.assign(embedding=out)

    return run
