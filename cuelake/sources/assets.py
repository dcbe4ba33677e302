"""Asset manifests, file inventories and retention listings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

ASSETS = "array<struct<stage:string,name:string,url:string,bytes:bigint,sha256:string,required:boolean>>"


def required_assets(manifests: DataFrame) -> DataFrame:
    """SRC-5 on a table (manifest_order, source_manifest, assets): required assets with a URL, each URL once (first manifest, then position),
    and a row for each manifest itself."""
    rows = manifests.select("manifest_order", "source_manifest", F.posexplode("assets").alias("pos", "asset")).select("manifest_order", "source_manifest", "pos", "asset.*")
    rows = rows.filter("coalesce(required, true) AND trim(coalesce(url, '')) <> ''").withColumn("required", F.lit(True))
    own = manifests.select("manifest_order", "source_manifest", F.lit(-1).alias("pos"), F.lit("manifest").alias("stage"), F.lit("manifest").alias("name"), F.col("source_manifest").alias("url"), F.lit(None).cast("bigint").alias("bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(True).alias("required"))
    first = F.row_number().over(Window.partitionBy("url").orderBy("manifest_order", "pos"))
    return own.unionByName(rows).withColumn("__n", first).filter("__n = 1").select("source_manifest", "stage", "name", "url", "bytes", "sha256", "required")


def read_asset_manifests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-5. Manifest files in the order given."""
    files = spark.read.schema(f"assets {ASSETS}").option("multiLine", True).json(paths).select("assets", F.col("_metadata.file_path").alias("file"))
    order = F.when(F.lit(False), 0)
    for k, p in enumerate(paths):
        order = order.when(F.col("file").endswith(p.rsplit("/", 1)[-1]) & F.col("file").contains(p), k)
    return required_assets(files.select(F.coalesce(order, F.lit(len(paths))).alias("manifest_order"), F.col("file").alias("source_manifest"), F.coalesce("assets", F.array().cast(ASSETS)).alias("assets")))


def inventory_of(files: DataFrame, path: str) -> DataFrame:
    """SRC-6 on a table (path, length, content) of the files under path; files.file_inventory reads a tree."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:/*"
    root = re.sub(scheme, "/", path).rstrip("/") + "/"
    url = F.substring(F.regexp_replace("path", scheme, "/"), len(root) + 1, 1 << 20)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return files.select(name.alias("name"), url.alias("url"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.lit(True).alias("required")).orderBy("url")


def expired_artifacts(files: DataFrame, now, days: float, suffix: str = ".srt") -> DataFrame:
    """SRC-8. Files (path, modificationTime) older than `days` before now, by path; none where days <= 0. Deleting is left to the caller."""
    limit = F.lit(now).cast("timestamp").cast("double") - days * 86_400
    return files.filter(F.col("path").endswith(suffix) & (F.col("modificationTime").cast("timestamp").cast("double") < limit) & F.lit(days > 0)).orderBy("path")
