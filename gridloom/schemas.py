"""Every schema in one place; readers use these and never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
    "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
}


def _schema(text: str) -> StructType:
    """A schema from `name TYPE, …`; unlike Spark's own parser it needs no session."""
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])


SERIES_INDEX = _schema(
    "collection_id STRING, source_DOI STRING, license_short_name STRING, PatientID STRING, StudyInstanceUID STRING, SeriesInstanceUID STRING, "
    "series_size_MB DOUBLE, series_aws_url STRING, aws_bucket STRING, crdc_series_uuid STRING, Modality STRING"
)
SERIES_ATTRIBUTES = _schema(
    "SeriesInstanceUID STRING, min_PixelSpacing_2sf DOUBLE, max_TotalPixelMatrixColumns BIGINT, max_TotalPixelMatrixRows BIGINT, ObjectiveLensPower DOUBLE, "
    "primaryAnatomicStructure_CodeMeaning STRING, primaryAnatomicStructureModifier_CodeMeaning STRING, staining_usingSubstance_CodeMeaning STRING, "
    "tissueFixative_CodeMeaning STRING, embeddingMedium_CodeMeaning STRING, illuminationType_CodeMeaning STRING"
)
INSTANCE_INDEX = _schema(
    "SeriesInstanceUID STRING, SOPInstanceUID STRING, PixelSpacing_0 DOUBLE, TotalPixelMatrixColumns BIGINT, TotalPixelMatrixRows BIGINT, "
    "instance_size BIGINT, TransferSyntaxUID STRING, ImageType ARRAY<STRING>"
)
SLIDE_RECORD = _schema("slide_id STRING, preprocess_dir STRING, qc_path STRING, features_path STRING, slide_path STRING")
TILE_MANIFEST = _schema(
    "slide_id STRING, tile_id BIGINT, grid_i INT, grid_j INT, x0_lvl0 BIGINT, y0_lvl0 BIGINT, x1_lvl0 BIGINT, y1_lvl0 BIGINT, "
    "tissue_frac DOUBLE, artifact_frac DOUBLE, rejected BOOLEAN, reject_reason STRING"
)
QC_GRID = _schema("slide_id STRING, grid_i INT, grid_j INT, tissue_frac FLOAT, artifact_frac FLOAT")
FEATURE_GRID = _schema("slide_id STRING, block_i INT, block_j INT, grid_i INT, grid_j INT, features ARRAY<FLOAT>, valid BOOLEAN")
CANDIDATE = _schema(
    "slide_id STRING, roi_id INT, grid_i INT, grid_j INT, tissue_frac DOUBLE, artifact_frac DOUBLE, group_id INT, embedding ARRAY<FLOAT>, passed_qc BOOLEAN, reject_reason STRING"
)
_CHOSEN = T.ArrayType(_schema("roi_id INT, grid_i INT, grid_j INT, tissue_frac DOUBLE, artifact_frac DOUBLE, group_id INT"))
ROI_SAMPLES = StructType(
    [T.StructField("slide_id", T.StringType()), T.StructField("roi_size", T.IntegerType()), T.StructField("passed_candidates", _CHOSEN), T.StructField("selected_candidates", _CHOSEN), T.StructField("metadata", T.StringType())]
)
CROP_VIEW = _schema("roi_id STRING, view_type STRING, r0 INT, c0 INT, size INT, cell INT, features ARRAY<FLOAT>, valid BOOLEAN, masked BOOLEAN")


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """df's columns as the schema has them; a missing column is an error, others are dropped."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in schema))
