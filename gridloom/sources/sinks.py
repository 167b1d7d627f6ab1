"""Where manifests, grids, features and samples go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from gridloom.schemas import FEATURE_GRID, TILE_MANIFEST, require
from gridloom.storage import cut


def without_nan(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null, as JSON has neither."""
    cols = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line; nulls keep their keys, text stays unescaped Unicode, times are ISO."""
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def write_manifest(df: DataFrame, prefix: str) -> None:
    df.write.mode("overwrite").parquet(f"{prefix}.parquet")
    write_jsonl(df, f"{prefix}.jsonl")


def write_tile_manifest(tiles: DataFrame, path: str) -> None:
    """Tiles by slide, with the declared types; rows of one slide may be replaced without touching others."""
    rows = require(tiles, TILE_MANIFEST).repartition("slide_id").sortWithinPartitions("slide_id", "rejected", "tile_id")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slide_id").parquet(path)


#: Folders of a feature store: a slide is in one of them, whatever the number of slides and blocks. A folder gets at most so
#: many files each time, by block rows, so a large slide is not one task's and files stay few.
STORE_BUCKETS, BUCKET_FILES = 256, 8


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _bucketed(rows: DataFrame) -> DataFrame:
    bucket = F.pmod(F.xxhash64(F.col("slide_id").cast("string")), F.lit(STORE_BUCKETS)).cast("int")
    placed = require(rows, FEATURE_GRID).withColumn("bucket", bucket)
    return placed.repartition("bucket", F.pmod(F.xxhash64("slide_id", "block_i"), F.lit(BUCKET_FILES))).sortWithinPartitions("bucket", "slide_id", "block_i", "block_j")


def write_features(rows: DataFrame, path: str) -> None:
    """Append feature cells that the store lacks.

    Folders are buckets of slides; within a file cells are sorted by slide and block, so row groups are pruned by both.
    """
    _bucketed(rows).write.mode("append").partitionBy("bucket").parquet(path)


def replace_features(store: DataFrame, rows: DataFrame, path: str) -> None:
    """Put cells into the store that it may have already; only the buckets of their slides are written anew.

    The new buckets are first written to the shared folder, as a table cannot be read while it is replaced.
    """
    from gridloom.operators.encode import upserted

    new = _bucketed(rows).select("bucket").distinct()
    old = require(store, FEATURE_GRID).withColumn("bucket", F.pmod(F.xxhash64(F.col("slide_id").cast("string")), F.lit(STORE_BUCKETS)).cast("int"))
    touched = old.join(F.broadcast(new), "bucket", "left_semi").drop("bucket")
    merged = cut(upserted(touched, require(rows, FEATURE_GRID)), "store-buckets")
    _bucketed(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def metadata_json(slides: DataFrame, extra: str = "extra") -> DataFrame:
    """(slide_id, metadata): a JSON document of the slide's columns; keys of the map `extra` never override them."""
    own = [c for c in slides.columns if c != extra]
    base = F.from_json(F.to_json(F.struct(*own), {"ignoreNullFields": "false"}), "map<string,string>")
    kept = F.map_filter(F.coalesce(F.col(extra), F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.array(*map(F.lit, own)), k)) if extra in slides.columns else F.create_map().cast("map<string,string>")
    return slides.select("slide_id", F.to_json(F.map_concat(kept, base), {"ignoreNullFields": "false"}).alias("metadata"))


def samples_document(candidates: DataFrame, roi_size: int, metadata: dict[str, str] | None = None) -> DataFrame:
    """One row per slide as the samples document: passed and selected candidates as arrays, in order (at most MOST_LISTED each)."""
    from gridloom.operators.select import checked_list

    item = F.struct("roi_id", "grid_i", "grid_j", "tissue_frac", "artifact_frac", "group_id")
    listed = candidates.groupBy("slide_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("passed_qc"), item))).alias("passed_candidates"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("pick").isNotNull(), F.struct("pick", item.alias("c"))))), lambda x: x["c"]).alias("selected_candidates"),
    )
    listed = checked_list(listed, "slide_id", "passed_candidates")
    note = F.to_json(F.create_map(*[F.lit(x) for kv in (metadata or {"sampler": "gridloom"}).items() for x in kv]))
    return listed.select("slide_id", F.lit(roi_size).alias("roi_size"), "passed_candidates", "selected_candidates", note.alias("metadata"))


def write_samples(candidates: DataFrame, roi_size: int, path: str, metadata: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    samples_document(candidates, roi_size, metadata).write.mode(mode).option("ignoreNullFields", "false").json(path)
