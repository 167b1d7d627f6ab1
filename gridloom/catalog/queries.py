"""Every query by name. `query(sql)` registers a function under its own name with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.catalog import fixtures as fx
from gridloom.catalog.fixtures import N_COLS, N_ROWS, R
from gridloom.functions import scalar as sc
from gridloom.operators import curate, encode, grid, groups, sampling, segment, select, vectors, views
from gridloom.plans import jobs
from gridloom.sources import readers, sinks
from gridloom.storage import cut, scratch_path
from gridloom.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _half(x: str) -> str:
    """SQL of a number in half precision."""
    unit = f"pow(2, greatest(floor(log2(abs(nullif({x}, 0)))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0::DOUBLE ELSE round_even({x} / {unit}, 0) * {unit} END"


def _u(key: str, seed: str = "0") -> str:
    """SQL of a row's draw in (0, 1)."""
    return f"(('0x'||substr(md5(({key})||':{seed}'),1,7))::BIGINT+1)/268435457::DOUBLE"


def _q(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE"


I_, S_, G_, V_ = f"inst AS ({fx.INST})", f"series AS ({fx.SERIES})", f"grid AS ({fx.GRID})", f"vec AS ({fx.VEC})"

# ---------------------------------------------------------------- curation

TARGET, BAND = 0.05, (0.045, 0.055)


def _slides(spark: SparkSession, sf: str) -> DataFrame:
    return curate.slide_table(fx.inst(spark, sf), fx.series(spark, sf), "series_id", "kinds", "px_spacing", "px_cols", "instance_size", TARGET, BAND)


_REST = ("sop_id", "px_spacing", "px_cols", "px_rows", "instance_size", "transfer_syntax")
_TIES = ", ".join(f"{c} DESC NULLS LAST" for c in _REST)
SLIDES = _with(
    I_, S_,
    f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY px_cols DESC NULLS LAST, instance_size DESC NULLS LAST, {_TIES}) AS rb,
 row_number() OVER (PARTITION BY series_id ORDER BY abs(px_spacing - 0.05::DOUBLE) ASC NULLS LAST, px_cols DESC NULLS LAST, {_TIES}) AS rx,
 max(CASE WHEN px_spacing BETWEEN 0.045::DOUBLE AND 0.055::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY series_id) AS has_x20_level
 FROM inst WHERE list_contains([image_kind], 'VOLUME'))""",
    f"""slides AS (SELECT s.*, {', '.join(f'b.{c} AS base_{c}' for c in _REST)}, {', '.join(f'x.{c} AS x20_{c}' for c in _REST)}, b.has_x20_level
 FROM series s JOIN ranked b ON b.series_id = s.series_id AND b.rb = 1 JOIN ranked x ON x.series_id = s.series_id AND x.rx = 1)""",
)


@query(SLIDES + "SELECT * FROM slides")
def slide_table(spark, sf):
    return _slides(spark, sf)


_NAMES = {"cols": "base_px_cols", "rows": "base_px_rows", "size_mb": "series_size", "power": "x20_px_cols", "spacing": "x20_px_spacing", "base_spacing": "base_px_spacing", "has_x20": "has_x20_level", "syntax": "base_transfer_syntax"}


@query(
    SLIDES
    + """SELECT * FROM slides WHERE patient_id IS NOT NULL AND site IS NOT NULL AND base_px_cols >= 10 AND base_px_rows >= 10 AND series_size >= 30000 AND series_size <= 400000
 AND x20_px_cols BETWEEN 5 AND 45 AND x20_px_spacing BETWEEN 0.05::DOUBLE - 0.02::DOUBLE AND 0.05::DOUBLE + 0.02::DOUBLE AND base_px_spacing <= 0.08::DOUBLE AND has_x20_level = 1 AND base_transfer_syntax IN ('O', 'F')"""
)
def quality_filters(spark, sf):
    limits = curate.QualityLimits(10, 10, (30000, 400000), (5, 45), (0.05, 0.02), 0.08, True, ("O", "F"))
    return curate.quality_filters(_slides(spark, sf), limits, _NAMES, ("patient_id", "site"))


def _dense(spark, sf):
    out = curate.density(_slides(spark, sf), "series_size", F.col("base_px_cols"), F.col("base_px_rows"), F.col("has_x20_level"), (F.col("x20_px_cols"), F.col("x20_px_rows")), 1e3)
    return out.select("series_id", "patient_id", "site", "stain", "collection_id", "area_mpix", "mb_per_mpix").withColumn("grp", sc.density_key("site_codec", site="site", codec="stain", collection="collection_id"))


DENSE = SLIDES.rstrip() + """,
areas AS (SELECT *, CAST(CASE WHEN has_x20_level = 1 THEN x20_px_cols ELSE base_px_cols END AS DOUBLE) * CAST(CASE WHEN has_x20_level = 1 THEN x20_px_rows ELSE base_px_rows END AS DOUBLE) / 1000::DOUBLE AS area_mpix FROM slides),
dense AS (SELECT series_id, patient_id, site, stain, collection_id, area_mpix, series_size / nullif(area_mpix, 0) AS mb_per_mpix, site || '||' || stain AS grp FROM areas)
"""


@query(DENSE + "SELECT * FROM dense")
def density_proxy(spark, sf):
    return _dense(spark, sf)


@query(DENSE + """, r AS (SELECT *, (rank() OVER (ORDER BY mb_per_mpix) + (count(*) OVER (PARTITION BY mb_per_mpix) - 1) / 2::DOUBLE) / (count(*) OVER ())::DOUBLE AS pct FROM dense WHERE mb_per_mpix IS NOT NULL)
SELECT * FROM r WHERE pct >= 1::DOUBLE - 0.25::DOUBLE""")
def density_global_topq(spark, sf):
    return curate.density_filter(cut(_dense(spark, sf), "dense"), "global_topq", 0.25)


@query(DENSE + """, r AS (SELECT *, (rank() OVER (PARTITION BY grp ORDER BY mb_per_mpix) + (count(*) OVER (PARTITION BY grp, mb_per_mpix) - 1) / 2::DOUBLE) / (count(*) OVER (PARTITION BY grp)) AS pct FROM dense WHERE mb_per_mpix IS NOT NULL AND grp IS NOT NULL)
SELECT * FROM r WHERE pct >= 1::DOUBLE - 0.25::DOUBLE""")
def density_group_topq(spark, sf):
    return curate.density_filter(_dense(spark, sf), "group_topq", 0.25, group="grp")


@query(DENSE + "SELECT * FROM dense WHERE mb_per_mpix >= 150")
def density_threshold(spark, sf):
    return curate.density_filter(_dense(spark, sf), "threshold", least=150.0)


@query(_with(S_, "x AS (SELECT series_id, collection_id AS c, nullif(site, '5-LOW') AS s, nullif(stain, 'P') AS t FROM series)") + """SELECT series_id, replace(lower(upper(c) || '-A'), '-', '_') AS collection_norm,
 s AS d_site, s || '||' || t AS d_site_codec, c || '||' || s || '||' || t AS d_all, c AS b_collection, c || '||' || coalesce(s, 'UNKNOWN') AS b_collection_site, c || '||' || coalesce(s, 'UNKNOWN') || '||' || coalesce(t, 'UNKNOWN') AS b_all FROM x""")
def group_keys(spark, sf):
    s = fx.series(spark, sf).withColumn("site", F.nullif("site", F.lit("5-LOW"))).withColumn("stain", F.nullif("stain", F.lit("P")))
    name = sc.normalised_name(F.concat(F.upper("collection_id"), F.lit("-A")))
    dense = lambda mode: sc.density_key(mode, site="site", codec="stain", collection="collection_id")
    ranked = s.select("series_id", name.alias("collection_norm"), dense("site").alias("d_site"), dense("site_codec").alias("d_site_codec"), dense("collection_site_codec").alias("d_all"), "collection_id", "site", "stain")
    filled = sc.unknown_filled(ranked, ["site", "stain"])
    group = lambda mode: sc.balance_key(mode, collection="collection_id", site="site", stain="stain")
    return filled.select("series_id", "collection_norm", "d_site", "d_site_codec", "d_all", group("collection").alias("b_collection"), group("collection_site").alias("b_collection_site"), group("collection_site_stain").alias("b_all"))


@query(_with(S_) + "SELECT * FROM series QUALIFY row_number() OVER (PARTITION BY site ORDER BY md5(series_id::VARCHAR || ':0'), series_id) <= 50")
def balanced_per_group(spark, sf):
    return curate.sample_per_group(fx.series(spark, sf), "site", "series_id", 50)


_SITES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _greedy(n: int) -> str:
    parts = [S_, "b AS (SELECT *, md5(series_id::VARCHAR || ':0') AS r FROM series)"]
    for k, site in enumerate(_SITES):
        taken = "".join(f" AND patient_id NOT IN (SELECT patient_id FROM g{m})" for m in range(k))
        parts.append(f"g{k} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY r, series_id) AS n FROM b WHERE site = '{site}'{taken}) WHERE n = 1 ORDER BY r, series_id LIMIT {n})")
    return _with(*parts) + " UNION ALL ".join(f"SELECT * EXCLUDE (r) FROM g{k}" for k in range(len(_SITES)))


@query(_greedy(250))
def balanced_unique_patient(spark, sf):
    return curate.balanced_unique(cut(fx.series(spark, sf), "series"), "site", "patient_id", "series_id", 250)


SPLIT = _with(
    S_,
    "p AS (SELECT DISTINCT patient_id FROM series)",
    "t AS (SELECT patient_id FROM p QUALIFY row_number() OVER (ORDER BY md5(patient_id::VARCHAR || ':0'), patient_id) <= ceil(0.2::DOUBLE * count(*) OVER ()))",
    "v AS (SELECT patient_id FROM p WHERE patient_id NOT IN (SELECT patient_id FROM t) QUALIFY row_number() OVER (ORDER BY md5(patient_id::VARCHAR || ':1'), patient_id) <= ceil(0.1::DOUBLE * count(*) OVER ()))",
)


@query(SPLIT + "SELECT *, CASE WHEN patient_id IN (SELECT patient_id FROM t) THEN 'test' WHEN patient_id IN (SELECT patient_id FROM v) THEN 'val' ELSE 'train' END AS split FROM series")
def patient_split(spark, sf):
    return curate.split_groups(fx.series(spark, sf), "patient_id", 0.2, 0.1)


@query(SPLIT + "SELECT count(*) AS n_patients, 0::BIGINT AS n_leaks FROM p")
def split_leak_check(spark, sf):
    parts = curate.split_groups(fx.series(spark, sf), "patient_id", 0.2, 0.1)
    per = parts.groupBy("patient_id").agg(F.count_distinct("split").alias("n"))
    return per.agg(F.count("*").alias("n_patients"), F.count_if(F.col("n") > 1).alias("n_leaks"))


@query(_with(S_) + "SELECT site, count(*) AS n FROM series GROUP BY site ORDER BY n DESC, site LIMIT 20")
def top_sites(spark, sf):
    return curate.value_counts(fx.series(spark, sf), "site", 20)


@query(_with(S_) + f"SELECT count(*) AS n_rows, {_q('sum(series_size) / 1024', 2)} AS total_gb FROM series")
def size_totals(spark, sf):
    return curate.totals(fx.series(spark, sf), "series_size").withColumn("total_gb", sc.quantised("total_gb", 2))


@query(_with(S_) + "SELECT series_id, patient_id, nullif(site, '5-LOW') AS site, CASE WHEN stain <> 'P' THEN series_size END AS series_size FROM series")
def jsonl_roundtrip(spark, sf):
    rows = fx.series(spark, sf).select("series_id", "patient_id", F.nullif("site", F.lit("5-LOW")).alias("site"), F.when(F.col("stain") != "P", F.col("series_size")).otherwise(F.lit(float("nan"))).alias("series_size"))
    path = scratch_path(spark, "jsonl")
    sinks.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


_PATHS = "SELECT page_id, 'root/' || (page_id % 5)::VARCHAR || '/Case ' || (page_id % 40)::VARCHAR || '/f' || page_id::VARCHAR || CASE page_id % 4 WHEN 0 THEN '.SVS' WHEN 1 THEN '.tiff' WHEN 2 THEN '.dcm' ELSE '.txt' END AS path FROM pages"


def _paths(spark, sf):
    p = fx.table(spark, sf, "pages")
    i = F.col("page_id")
    end = F.when(i % 4 == 0, ".SVS").when(i % 4 == 1, ".tiff").when(i % 4 == 2, ".dcm").otherwise(".txt")
    return p.select(F.concat(F.lit("root/"), (i % 5).cast("string"), F.lit("/Case "), (i % 40).cast("string"), F.lit("/f"), i.cast("string"), end).alias("path"))


@query(f"WITH f AS ({_PATHS}) SELECT path AS slide_path FROM f WHERE lower(path) LIKE '%.svs' OR lower(path) LIKE '%.tiff' UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM f WHERE lower(path) LIKE '%.dcm'")
def discover_slides(spark, sf):
    return readers.slide_paths(_paths(spark, sf))


@query(f"""WITH f AS ({_PATHS}), s AS (SELECT path AS slide_path FROM f WHERE lower(path) LIKE '%.svs' OR lower(path) LIKE '%.tiff' UNION SELECT regexp_replace(path, '/[^/]*$', '') FROM f WHERE lower(path) LIKE '%.dcm'),
n AS (SELECT slide_path, regexp_replace(regexp_extract(slide_path, '[^/]*$'), '\\.[^.]*$', '') AS slide_id FROM s)
SELECT slide_id, 'out/' || slide_id || '_qc' AS preprocess_dir, 'out/' || slide_id || '_qc/qc' AS qc_path, 'out/' || slide_id || '_qc/features' AS features_path, slide_path FROM n""")
def slide_records(spark, sf):
    return readers.slide_records(readers.slide_paths(_paths(spark, sf)), "out")


# ---------------------------------------------------------------- scalar expressions


@query(f"""WITH c AS (SELECT c_custkey, CAST(c_acctbal / 10000 AS VARCHAR) AS a, c_mktsegment AS b, CAST(c_nationkey AS DOUBLE) / 40 AS d FROM customer),
v AS (SELECT c_custkey, list_filter([TRY_CAST(a AS DOUBLE), TRY_CAST(b AS DOUBLE), d], lambda x: x IS NOT NULL AND x > 0) AS l, TRY_CAST(b AS DOUBLE) AS p FROM c),
m AS (SELECT c_custkey, CASE WHEN len(l) > 0 THEN list_sum(l) / len(l) END AS mpp FROM v)
SELECT c_custkey, {_q('mpp')} AS mpp, {_q('10 / nullif(mpp, 0)', 4)} AS power, greatest(1, round_even(512::DOUBLE * ((10::DOUBLE / coalesce(mpp, 0.5::DOUBLE) / 20::DOUBLE * coalesce(mpp, 0.5::DOUBLE)) / coalesce(mpp, 0.5::DOUBLE)), 0))::INT AS tile FROM m""")
def spacing_and_tile(spark, sf):
    c = fx.table(spark, sf, "customer").select("c_custkey", sc.mean_spacing((F.col("c_acctbal") / 10000).cast("string"), "c_mktsegment", (F.col("c_nationkey").cast("double") / 40)).alias("mpp"), "c_mktsegment")
    power = sc.objective_power(F.col("mpp"), "c_mktsegment")
    return c.select("c_custkey", sc.quantised("mpp").alias("mpp"), sc.quantised(power, 4).alias("power"), sc.base_tile_size(512, F.col("mpp"), F.lit(None).cast("double"), 20).alias("tile"))


@query("""WITH d AS (SELECT p_partkey, unnest([0, 1, 2, 3]) AS level, unnest([1.0::DOUBLE, 4.0, 16.0, 64.0]) AS ds, p_retailprice / 50 AS want FROM part)
SELECT p_partkey, level FROM d QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(ln(ds / want)), level) = 1""")
def pyramid_level(spark, sf):
    widths = F.array(*[F.lit(w) for w in (64000.0, 16000.0, 4000.0, 1000.0)])
    return fx.table(spark, sf, "part").select("p_partkey", sc.pyramid_level(sc.downsamples(widths), F.col("p_retailprice") / 50).alias("level"))


@query(_with(G_) + f"SELECT tile_id, {_half('tissue_frac')} AS tissue_half, {_half('artifact_frac')} AS artifact_half FROM grid")
def half_quantise(spark, sf):
    return fx.tiles(spark, sf).select("tile_id", sc.to_half("tissue_frac").alias("tissue_half"), sc.to_half("artifact_frac").alias("artifact_half"))


@query(_with(G_) + """SELECT tile_id, greatest(0, tissue_frac * (1 - artifact_frac)) AS quality, least(1, greatest(0, tissue_frac * (1 - artifact_frac))) AS weight,
 pow(0.05::DOUBLE + least(1, greatest(0, 1 - tissue_frac)), 1.0::DOUBLE) AS novelty, CASE WHEN tissue_frac < 0.7 THEN 'low_tissue' WHEN artifact_frac > 0.05 THEN 'high_artifact' END AS reject_reason,
 NOT (tissue_frac < 0.7 OR artifact_frac > 0.05) AS passed_qc, floor(tile_id * 512 / 100)::INT AS grid_index FROM grid""")
def tile_quality(spark, sf):
    t, a = F.col("tissue_frac"), F.col("artifact_frac")
    return sampling.gate(fx.tiles(spark, sf), 0.7, 0.05).select("tile_id", sc.quality(t, a).alias("quality"), sc.tile_weight(t, a).alias("weight"), sc.novelty(t, 1.0, 0.05).alias("novelty"), "reject_reason", "passed_qc", sc.grid_index(F.col("tile_id") * 512, 100).alias("grid_index"))


@query(_with(V_) + "SELECT vec_id, k::INT AS k, round_even(embedding[k + 1]::DOUBLE / 0.05::DOUBLE, 0) * 0.05::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM vec)")
def posterise(spark, sf):
    v = fx.vectors(spark, sf).select("vec_id", F.posexplode(sc.posterised(F.col("embedding").cast("array<double>"), 0.05)).alias("k", "value"))
    return v


@query(_with(V_) + f"SELECT vec_id, k::INT AS k, {_q('embedding[k + 1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))')} AS value FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM vec)")
def unit_vectors(spark, sf):
    return fx.vectors(spark, sf).select("vec_id", F.posexplode(sc.unit_vector(F.col("embedding"))).alias("k", "x")).select("vec_id", "k", sc.quantised("x").alias("value"))


@query("SELECT range AS step, CASE WHEN TRUE THEN 0.996::DOUBLE + (0.9999::DOUBLE - 0.996::DOUBLE) * least(1, greatest(0, range / 999::DOUBLE)) END AS momentum FROM range(1200)")
def ema_schedule(spark, sf):
    return spark.range(1200).select(F.col("id").alias("step"), sc.momentum(F.col("id"), 1000, 0.996, 0.9999).alias("momentum"))


@query(f"SELECT range AS step, {_q('CASE WHEN range < 50 THEN (range + 1) / 50::DOUBLE ELSE 0.5::DOUBLE * (1 + cos(pi() * ((range - 50) / 950::DOUBLE))) END')} AS rate FROM range(1000)")
def cosine_schedule(spark, sf):
    return spark.range(1000).select(F.col("id").alias("step"), sc.quantised(sc.cosine_rate(F.col("id"), 1000, 50)).alias("rate"))


@query(_with(G_) + f"""SELECT tile_id, k::INT AS k, {_q("CASE (k // 4) % 2 WHEN 0 THEN sin((CASE WHEN k < 8 THEN grid_i ELSE grid_j END) * (1 / pow(10000, (k % 4) / 4::DOUBLE))) ELSE cos((CASE WHEN k < 8 THEN grid_i ELSE grid_j END) * (1 / pow(10000, (k % 4) / 4::DOUBLE))) END")} AS value FROM grid, range(16) t(k)""")
def sincos_positions(spark, sf):
    return fx.tiles(spark, sf).select("tile_id", F.posexplode(sc.sincos_position(F.col("grid_i"), F.col("grid_j"), 16)).alias("k", "x")).select("tile_id", "k", sc.quantised("x").alias("value"))


# ---------------------------------------------------------------- grids

TILE, SCALE, WIDTH, HEIGHT = 20, 0.125, 160, 80


def _masks(spark, sf):
    t = fx.tiles(spark, sf)
    at = lambda flag: t.select(F.col("slide_id"), F.col("grid_i").alias("y"), F.col("grid_j").alias("x"), flag.alias("flag"))
    return cut(at(F.col("tissue_frac") >= 0.9), "tissue"), cut(at(F.col("artifact_frac") > 0.05), "artifact")


def _tiled(spark, sf):
    tissue, artifact = _masks(spark, sf)
    slides = tissue.select("slide_id").distinct().select("slide_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(TILE).alias("tile"), F.lit(SCALE).alias("scale_x"), F.lit(SCALE).alias("scale_y"))
    return jobs.tile_grid(slides, tissue, artifact, 0.1)


TILED = _with(
    G_,
    "m AS (SELECT slide_id, grid_i AS y, grid_j AS x, tissue_frac >= 0.9 AS tissue, artifact_frac > 0.05 AS artifact FROM grid)",
    "box AS (SELECT slide_id, min(y) AS min_y, max(y) + 1 AS max_y, min(x) AS min_x, max(x) + 1 AS max_x FROM m WHERE tissue GROUP BY slide_id)",
    f"""ext AS (SELECT slide_id, (floor(greatest(0, floor(min_x / {SCALE}) - {TILE}) / {TILE}) * {TILE})::BIGINT AS x0, least({WIDTH}, floor(max_x / {SCALE}) + {TILE}) AS sx1,
 (floor(greatest(0, floor(min_y / {SCALE}) - {TILE}) / {TILE}) * {TILE})::BIGINT AS y0, least({HEIGHT}, floor(max_y / {SCALE}) + {TILE}) AS sy1 FROM box)""",
    f"dim AS (SELECT *, greatest(1, ceil((sx1 - x0) / {TILE}))::INT AS n_cols, greatest(1, ceil((sy1 - y0) / {TILE}))::INT AS n_rows FROM ext)",
    "cells AS (SELECT *, unnest(range(n_cols)) AS grid_j FROM (SELECT *, unnest(range(n_rows)) AS grid_i FROM dim))",
    f"""tl AS (SELECT slide_id, grid_i * n_cols + grid_j AS tile_id, grid_i::INT AS grid_i, grid_j::INT AS grid_j, x0 + grid_j * {TILE} AS x0_lvl0, y0 + grid_i * {TILE} AS y0_lvl0,
 least(x0 + (grid_j + 1) * {TILE}, {WIDTH}) AS x1_lvl0, least(y0 + (grid_i + 1) * {TILE}, {HEIGHT}) AS y1_lvl0 FROM cells)""",
    f"""fr AS (SELECT t.slide_id, t.tile_id, avg(CASE WHEN tissue THEN 1.0::DOUBLE ELSE 0 END) AS tissue_frac, avg(CASE WHEN artifact THEN 1.0::DOUBLE ELSE 0 END) AS artifact_frac FROM tl t JOIN m ON m.slide_id = t.slide_id
 AND m.y >= floor(y0_lvl0 * {SCALE}) AND m.y < ceil(y1_lvl0 * {SCALE}) AND m.x >= floor(x0_lvl0 * {SCALE}) AND m.x < ceil(x1_lvl0 * {SCALE}) GROUP BY ALL)""",
    "judged AS (SELECT tl.*, fr.tissue_frac, fr.artifact_frac, fr.tissue_frac < 0.1 AS rejected, CASE WHEN fr.tissue_frac < 0.1 THEN 'low_tissue' END AS reject_reason FROM tl JOIN fr USING (slide_id, tile_id))",
)


@query(TILED + "SELECT * FROM judged")
def tile_grid(spark, sf):
    return _tiled(spark, sf)


@query(TILED + "SELECT slide_id, count(*) AS total_grid_tiles, count(*) FILTER (WHERE NOT rejected) AS accepted_count, count(*) FILTER (WHERE rejected) AS rejected_count, count(*) FILTER (WHERE reject_reason = 'low_tissue') AS rejected_low_tissue FROM judged GROUP BY slide_id")
def tile_reject(spark, sf):
    return grid.grid_summary(_tiled(spark, sf))


@query(_with(G_) + """, t AS (SELECT slide_id, tile_id, x0, least(x0 + 30, 160) AS x1, y0, least(y0 + 30, 80) AS y1 FROM (SELECT DISTINCT slide_id FROM grid), (SELECT (i * 6 + j) AS tile_id, j * 30 AS x0, i * 30 AS y0 FROM range(3) a(i), range(6) b(j)))
SELECT t.slide_id, t.tile_id, avg(CASE WHEN tissue_frac >= 0.9 THEN 1.0::DOUBLE ELSE 0 END) AS fraction FROM t JOIN grid g ON g.slide_id = t.slide_id AND grid_i >= floor(y0 * 0.125) AND grid_i < ceil(y1 * 0.125) AND grid_j >= floor(x0 * 0.125) AND grid_j < ceil(x1 * 0.125) GROUP BY ALL""")
def mask_fraction(spark, sf):
    tissue, _ = _masks(spark, sf)
    ext = tissue.select("slide_id").distinct().select("slide_id", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), F.lit(30).alias("tile"), F.lit(SCALE).alias("scale_x"), F.lit(SCALE).alias("scale_y"), F.lit(0).cast("long").alias("x0"), F.lit(0).cast("long").alias("y0"), F.lit(6).alias("n_cols"), F.lit(3).alias("n_rows"))
    return grid.mask_fractions(grid.tiles_of(ext), tissue, "flag").select("slide_id", "tile_id", "fraction")


@query(_with(G_) + "SELECT slide_id, min(grid_i) AS min_y, max(grid_i) + 1 AS max_y, min(grid_j) AS min_x, max(grid_j) + 1 AS max_x FROM grid WHERE tissue_frac >= 0.9 GROUP BY slide_id")
def tissue_bbox(spark, sf):
    return grid.bounding_box(fx.tiles(spark, sf).where("tissue_frac >= 0.9"), y="grid_i", x="grid_j")


@query(_with(G_) + "SELECT a.slide_id, a.grid_i, a.grid_j, sum(b.size)::BIGINT AS prefix FROM grid a JOIN grid b ON a.slide_id = b.slide_id AND b.grid_i <= a.grid_i AND b.grid_j <= a.grid_j GROUP BY ALL")
def prefix_sum_2d(spark, sf):
    return grid.summed_table(fx.tiles(spark, sf), "size").select("slide_id", "grid_i", "grid_j", "prefix")


_BOX = f"FROM grid a JOIN grid b ON a.slide_id = b.slide_id AND b.grid_i BETWEEN a.grid_i AND a.grid_i + {R - 1} AND b.grid_j BETWEEN a.grid_j AND a.grid_j + {R - 1} WHERE a.grid_i <= {N_ROWS - R} AND a.grid_j <= {N_COLS - R} GROUP BY a.slide_id, a.grid_i, a.grid_j"


@query(_with(G_) + f"SELECT a.slide_id, a.grid_i, a.grid_j, sum(b.size)::BIGINT AS total {_BOX}")
def box_sum(spark, sf):
    return grid.box_sums(fx.tiles(spark, sf), {"total": F.col("size")}, R)


WINDOWS = _with(
    G_,
    f"h AS (SELECT slide_id, grid_i, grid_j, {_half('tissue_frac')} AS t, {_half('artifact_frac')} AS a FROM grid)",
    f"""win AS (SELECT a.slide_id, a.grid_i, a.grid_j, sum(b.t) / {R * R} AS tissue_frac, sum(b.a) / {R * R} AS artifact_frac, count(*) FILTER (WHERE b.t >= 0.3) AS n_valid {_BOX.replace('FROM grid a JOIN grid b', 'FROM h a JOIN h b')})""",
)


def _windows(spark, sf):
    return grid.window_metrics(fx.tiles(spark, sf), R, 0.3)


@query(WINDOWS + "SELECT * FROM win")
def window_metrics(spark, sf):
    return _windows(spark, sf)


@query(WINDOWS + f", s AS (SELECT slide_id, max(n_valid) >= {int(-(-0.9 * R * R // 1))} AS viable FROM win GROUP BY slide_id) SELECT * FROM s")
def roi_viability(spark, sf):
    return grid.viable(fx.tiles(spark, sf), R, 0.3, 0.9)


def _offsets(radius: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, dx in grid.ellipse(radius))


@query(_with(G_) + f"SELECT DISTINCT slide_id, grid_i + dy AS grid_i, grid_j + dx AS grid_j FROM grid, (VALUES {_offsets(2)}) o(dy, dx) WHERE size >= 45 AND grid_i + dy BETWEEN 0 AND {N_ROWS - 1} AND grid_j + dx BETWEEN 0 AND {N_COLS - 1}")
def dilate(spark, sf):
    t = fx.tiles(spark, sf)
    dims = t.groupBy("slide_id").agg((F.max("grid_i") + 1).alias("n_rows"), (F.max("grid_j") + 1).alias("n_cols"))
    return grid.dilated(t.where("size >= 45"), 2, dims)


_IN = f"{{i}} BETWEEN 0 AND {N_ROWS - 1} AND {{j}} BETWEEN 0 AND {N_COLS - 1}"


def _eroded(name: str, of: str) -> str:
    """SQL of an erosion: as many of the kernel's places are in the set as are in the grid."""
    moved = _IN.format(i="grid_i + dy", j="grid_j + dx")
    return f"""{name}_at AS (SELECT DISTINCT slide_id, grid_i - dy AS grid_i, grid_j - dx AS grid_j FROM {of}, o WHERE {_IN.format(i='grid_i - dy', j='grid_j - dx')}),
{name} AS (SELECT a.slide_id, a.grid_i, a.grid_j FROM (SELECT *, grid_i + dy AS i, grid_j + dx AS j FROM {name}_at, o WHERE {moved}) a
 LEFT JOIN {of} d ON d.slide_id = a.slide_id AND d.grid_i = a.i AND d.grid_j = a.j GROUP BY a.slide_id, a.grid_i, a.grid_j HAVING count(*) = count(d.slide_id))"""


def _dilated(name: str, of: str) -> str:
    return f"{name} AS (SELECT DISTINCT slide_id, grid_i + dy AS grid_i, grid_j + dx AS grid_j FROM {of}, o WHERE {_IN.format(i='grid_i + dy', j='grid_j + dx')})"


_CELLS = (G_, f"o AS (SELECT * FROM (VALUES {_offsets(1)}) o(dy, dx))", "c AS (SELECT slide_id, grid_i, grid_j FROM grid WHERE size >= 15)")


def _dims(t: DataFrame) -> DataFrame:
    return t.select("slide_id").distinct().select("slide_id", F.lit(N_ROWS).alias("n_rows"), F.lit(N_COLS).alias("n_cols"))


@query(_with(*_CELLS, _eroded("e", "c"), _dilated("d", "e")) + "SELECT * FROM d")
def morphology_open(spark, sf):
    t = fx.tiles(spark, sf)
    return grid.opened(t.where("size >= 15"), 1, _dims(t))


@query(_with(*_CELLS, _dilated("d", "c"), _eroded("e", "d")) + "SELECT * FROM e")
def morphology_close(spark, sf):
    t = fx.tiles(spark, sf)
    return grid.closed(t.where("size >= 15"), 1, _dims(t))


@query(
    _with(G_, "b AS (SELECT p_brand, p_size AS v, count(*) AS c FROM part GROUP BY ALL)",
          "r AS (SELECT *, sum(c) OVER w AS w0, sum(v * c) OVER w AS s0, sum(c) OVER (PARTITION BY p_brand) AS w, sum(v * c) OVER (PARTITION BY p_brand) AS s FROM b WINDOW w AS (PARTITION BY p_brand ORDER BY v ROWS UNBOUNDED PRECEDING))")
    + "SELECT p_brand, v AS threshold FROM r QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN w > w0 THEN (s0 * w - s * w0)::DOUBLE * (s0 * w - s * w0)::DOUBLE / (w0 * (w - w0))::DOUBLE ELSE 0 END DESC, v) = 1"
)
def otsu_threshold(spark, sf):
    return grid.otsu_threshold(fx.table(spark, sf, "part"), "p_size", "p_brand")


def _source(k: str, n_in: int, n_out: int) -> str:
    return f"least(greatest(trunc(({k} + 0.5::DOUBLE) * {n_in / n_out!r}::DOUBLE - 0.5::DOUBLE), 0), {n_in - 1})::INT"


@query(_with(G_) + f"SELECT g.slide_id, y::INT AS y, x::INT AS x, g.size FROM range(7) a(y), range(13) b(x) JOIN grid g ON g.grid_i = {_source('y', N_ROWS, 7)} AND g.grid_j = {_source('x', N_COLS, 13)}")
def nearest_resample(spark, sf):
    cells = fx.tiles(spark, sf).select("slide_id", F.col("grid_i").alias("y"), F.col("grid_j").alias("x"), "size")
    return grid.resampled(cells, (N_ROWS, N_COLS), (7, 13), "size")


def _floored(k: str, n_in: int, n_out: int) -> str:
    return f"least(floor({k} * {n_in / n_out!r}::DOUBLE), {n_in - 1})::INT"


@query(_with(G_) + f"SELECT g.slide_id, y::INT AS y, x::INT AS x, g.size FROM range(23) a(y), range(9) b(x) JOIN grid g ON g.grid_i = {_floored('y', N_ROWS, 23)} AND g.grid_j = {_floored('x', N_COLS, 9)}")
def floor_resample(spark, sf):
    cells = fx.tiles(spark, sf).select("slide_id", F.col("grid_i").alias("y"), F.col("grid_j").alias("x"), "size")
    return grid.resampled(cells, (N_ROWS, N_COLS), (23, 9), "size", centred=False)


# ---------------------------------------------------------------- groups

CELLS = "size >= 36"
COMPONENTS = (
    "WITH RECURSIVE "
    + ",\n".join([
        G_,
        f"c AS (SELECT slide_id, grid_i, grid_j, grid_i * {N_COLS} + grid_j AS v FROM grid WHERE {CELLS})",
        "e AS (SELECT a.slide_id, a.v AS a, b.v AS b FROM c a JOIN c b ON a.slide_id = b.slide_id AND abs(a.grid_i - b.grid_i) <= 1 AND abs(a.grid_j - b.grid_j) <= 1)",
        "reach AS (SELECT slide_id, v AS a, v AS b FROM c UNION SELECT r.slide_id, r.a, e.b FROM reach r JOIN e ON e.slide_id = r.slide_id AND e.a = r.b)",
        "lab AS (SELECT c.slide_id, c.grid_i, c.grid_j, min(r.b)::BIGINT AS component_id FROM c JOIN reach r ON r.slide_id = c.slide_id AND r.a = c.v GROUP BY ALL)",
        "st AS (SELECT slide_id, component_id, count(*) AS area, min(grid_i) AS min_i, max(grid_i) + 1 AS max_i, min(grid_j) AS min_j, max(grid_j) + 1 AS max_j FROM lab GROUP BY ALL)",
    ])
    + "\n"
)


def _labelled(spark, sf):
    return groups.components(fx.tiles(spark, sf).where(CELLS).withColumn("n_cols", F.lit(N_COLS)))


@query(COMPONENTS + "SELECT * FROM lab")
def components(spark, sf):
    return _labelled(spark, sf)


@query(COMPONENTS + "SELECT * FROM st WHERE area >= 3")
def component_stats(spark, sf):
    return groups.component_stats(_labelled(spark, sf), 3)


PLACED = COMPONENTS.rstrip() + """,
ok AS (SELECT * FROM st WHERE area >= 4 * 0.3 AND max_i - min_i >= 2 AND max_j - min_j >= 2),
pos AS (SELECT slide_id, component_id, i.i AS grid_i, j.j AS grid_j FROM ok, range(10) i(i), range(20) j(j) WHERE i.i BETWEEN min_i AND max_i - 2 AND j.j BETWEEN min_j AND max_j - 2),
placed AS (SELECT p.slide_id, p.component_id, p.grid_i::INT AS grid_i, p.grid_j::INT AS grid_j FROM pos p JOIN lab l ON l.slide_id = p.slide_id AND l.component_id = p.component_id AND l.grid_i BETWEEN p.grid_i AND p.grid_i + 1 AND l.grid_j BETWEEN p.grid_j AND p.grid_j + 1
 GROUP BY ALL HAVING count(*) >= 4 * 0.6)
"""


@query(PLACED + "SELECT * FROM placed")
def placements(spark, sf):
    return groups.group_placements(_labelled(spark, sf), 2, 0.6)


@query(PLACED + "SELECT p.slide_id, p.component_id, p.n_placements, sqrt(p.n_placements) AS weight, area, min_i, max_i, min_j, max_j FROM (SELECT slide_id, component_id, count(*) AS n_placements FROM placed GROUP BY ALL) p JOIN st USING (slide_id, component_id)")
def group_weights(spark, sf):
    labelled = cut(_labelled(spark, sf), "labelled")
    return groups.group_weights(groups.group_placements(labelled, 2, 0.6), groups.component_stats(labelled))


# ---------------------------------------------------------------- sampling

_KEY = "slide_id::VARCHAR || '/' || grid_i::VARCHAR || '/' || grid_j::VARCHAR"
ORDERED = WINDOWS.rstrip() + f""",
ord AS (SELECT slide_id, grid_i, grid_j, tissue_frac, artifact_frac, (row_number() OVER (PARTITION BY slide_id ORDER BY -ln({_u(_KEY)}) / (0.1::DOUBLE + tissue_frac), grid_i, grid_j) - 1)::INT AS roi_id FROM win),
gated AS (SELECT *, CASE WHEN tissue_frac < 0.5 THEN 'low_tissue' WHEN artifact_frac > 0.05 THEN 'high_artifact' END AS reject_reason, NOT (tissue_frac < 0.5 OR artifact_frac > 0.05) AS passed_qc FROM ord)
"""


def _ordered(spark, sf):
    w = _windows(spark, sf)
    key = F.concat_ws("/", F.col("slide_id").cast("string"), F.col("grid_i").cast("string"), F.col("grid_j").cast("string"))
    return sampling.candidate_order(w, F.lit(0.1) + F.col("tissue_frac"), key).select("slide_id", "grid_i", "grid_j", "tissue_frac", "artifact_frac", "roi_id")


def _gated(spark, sf):
    return sampling.gate(_ordered(spark, sf), 0.5, 0.05)


@query(ORDERED + "SELECT * FROM ord")
def candidate_order(spark, sf):
    return _ordered(spark, sf)


@query(ORDERED + "SELECT * FROM gated")
def qc_gate(spark, sf):
    return _gated(spark, sf)


@query(ORDERED + ", run AS (SELECT *, sum(CASE WHEN passed_qc THEN 1 ELSE 0 END) OVER (PARTITION BY slide_id ORDER BY roi_id ROWS UNBOUNDED PRECEDING) AS k FROM gated) SELECT * EXCLUDE (k) FROM run WHERE k - CASE WHEN passed_qc THEN 1 ELSE 0 END < 8 AND artifact_frac <= 0.1")
def candidate_until_target(spark, sf):
    return sampling.until_passed(_gated(spark, sf), 8).where(~sampling.hard_rejected(0.05))


@query(ORDERED + f"SELECT slide_id, {_q('least(1, greatest(0, quantile_cont(tissue_frac, 0.4)))')} AS tissue_thr, {_q('least(1, greatest(0, least(quantile_cont(artifact_frac, 0.6), 0.05::DOUBLE)))')} AS artifact_thr FROM ord GROUP BY slide_id")
def qc_percentile(spark, sf):
    t = sampling.gate_thresholds(_ordered(spark, sf), 0.5, 0.05, 40, 60)
    return t.select("slide_id", sc.quantised("tissue_thr").alias("tissue_thr"), sc.quantised("artifact_thr").alias("artifact_thr"))


@query(ORDERED + "SELECT slide_id, count(*) AS sampled, count(*) FILTER (WHERE passed_qc) AS passed, count(*) FILTER (WHERE NOT passed_qc) AS rejected, count(*) FILTER (WHERE reject_reason = 'low_tissue') AS low_tissue, count(*) FILTER (WHERE reject_reason = 'high_artifact') AS high_artifact FROM gated GROUP BY slide_id")
def gate_summary(spark, sf):
    return sampling.gate_summary(_gated(spark, sf))


@query(ORDERED + """, c AS (SELECT *, CASE WHEN slide_id % 3 = 0 AND roi_id = 3 THEN 0 WHEN slide_id % 3 = 0 AND roi_id = 5 THEN 1 WHEN slide_id % 3 = 1 AND roi_id = 4 THEN 0 END AS pick FROM gated),
o AS (SELECT slide_id, roi_id, row_number() OVER (PARTITION BY slide_id ORDER BY pick IS NULL, pick, tissue_frac * (1 - artifact_frac) DESC, roi_id) AS rn FROM c WHERE pick IS NOT NULL OR passed_qc)
SELECT slide_id, max(CASE WHEN rn = 1 THEN roi_id END) AS first, coalesce(max(CASE WHEN rn = 2 THEN roi_id END), max(CASE WHEN rn = 1 THEN roi_id END)) AS second FROM o WHERE rn <= 2 GROUP BY slide_id""")
def pick_pair(spark, sf):
    s, r = F.col("slide_id") % 3, F.col("roi_id")
    pick = F.when((s == 0) & (r == 3), 0).when((s == 0) & (r == 5), 1).when((s == 1) & (r == 4), 0)
    return select.pick_pair(_gated(spark, sf).withColumn("pick", pick))


_IOU = f"(greatest(0, {R} - abs(a.grid_i - b.grid_i)) * greatest(0, {R} - abs(a.grid_j - b.grid_j)))"


@query(WINDOWS + f"SELECT a.slide_id, a.grid_i AS a_grid_i, a.grid_j AS a_grid_j, b.grid_i AS b_grid_i, b.grid_j AS b_grid_j, {_IOU} / ({2 * R * R}::DOUBLE - {_IOU}) AS iou FROM win a JOIN win b ON a.slide_id = b.slide_id AND (a.grid_i, a.grid_j) <> (b.grid_i, b.grid_j) WHERE {_IOU} > 0")
def iou_pairs(spark, sf):
    p = select.overlapping_pairs(_windows(spark, sf), R)
    return p.withColumn("iou", sc.square_iou(F.col("a_grid_i"), F.col("a_grid_j"), F.col("b_grid_i"), F.col("b_grid_j"), R))


_REC_IOU = f"(greatest(0, {R} - abs(k.i - o.grid_i)) * greatest(0, {R} - abs(k.j - o.grid_j)))"


@query(
    WINDOWS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
    + f""",
o AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY tissue_frac DESC, grid_i, grid_j) AS n FROM win),
step AS (SELECT slide_id, 1::BIGINT AS n, [{{'i': grid_i, 'j': grid_j}}] AS kept FROM o WHERE n = 1
 UNION ALL SELECT s.slide_id, o.n, CASE WHEN list_max(list_transform(s.kept, lambda k: {_REC_IOU} / ({2 * R * R}::DOUBLE - {_REC_IOU}))) > 0.3 THEN s.kept ELSE list_append(s.kept, {{'i': o.grid_i, 'j': o.grid_j}}) END
 FROM step s JOIN o ON o.slide_id = s.slide_id AND o.n = s.n + 1),
last AS (SELECT slide_id, kept FROM step QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY n DESC) = 1)
SELECT slide_id, k.i AS grid_i, k.j AS grid_j FROM (SELECT slide_id, unnest(kept) AS k FROM last)"""
)
def nms_keep(spark, sf):
    return select.overlap_free(_windows(spark, sf), R, 0.3, F.struct((-F.col("tissue_frac")).alias("t"), "grid_i", "grid_j"))


_AWAY = "(greatest(0, 4 - abs(w.grid_i - h.grid_i)) * greatest(0, 4 - abs(w.grid_j - h.grid_j)))"


@query(WINDOWS + f", h AS (SELECT slide_id, arg_max(grid_i, (tissue_frac, -grid_i, -grid_j)) AS grid_i, arg_max(grid_j, (tissue_frac, -grid_i, -grid_j)) AS grid_j FROM win GROUP BY slide_id) SELECT w.* FROM win w JOIN h ON h.slide_id = w.slide_id WHERE {_AWAY} / (32::DOUBLE - {_AWAY}) <= 0.1".replace(", h AS (SELECT slide_id, arg", ", h2 AS (SELECT slide_id, arg").replace("JOIN h ON h.slide_id", "JOIN h2 h ON h.slide_id"))
def away_from_history(spark, sf):
    w = _windows(spark, sf)
    best = w.groupBy("slide_id").agg(F.max(F.struct("tissue_frac", (-F.col("grid_i")).alias("i"), (-F.col("grid_j")).alias("j"))).alias("b"))
    return select.away_from(w, best.select("slide_id", (-F.col("b.i")).alias("grid_i"), (-F.col("b.j")).alias("grid_j")), R, 0.1)


# ---------------------------------------------------------------- vectors

FEATURES = "ft AS (SELECT g.slide_id, g.grid_i, g.grid_j, v.embedding FROM grid g JOIN embeddings v ON v.vec_id = g.tile_id % (SELECT count(*) FROM embeddings))"


def _features(spark, sf):
    e = fx.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("features"))
    n = e.count()
    return fx.tiles(spark, sf).withColumn("vec_id", F.col("tile_id") % n).join(e, "vec_id").select("slide_id", "grid_i", "grid_j", "features")


@query(
    ORDERED.rstrip() + ",\n" + FEATURES
    + f""",
cell AS (SELECT o.slide_id, o.roi_id, h.t, least(1, greatest(0, h.t * (1 - h.a))) AS w, f.embedding FROM gated o JOIN h ON h.slide_id = o.slide_id AND h.grid_i BETWEEN o.grid_i AND o.grid_i + {R - 1} AND h.grid_j BETWEEN o.grid_j AND o.grid_j + {R - 1} AND h.t >= 0.3
 JOIN ft f ON f.slide_id = h.slide_id AND f.grid_i = h.grid_i AND f.grid_j = h.grid_j WHERE o.passed_qc),
x AS (SELECT slide_id, roi_id, w, k, embedding[k + 1]::DOUBLE AS v FROM (SELECT slide_id, roi_id, w, embedding, unnest(range(len(embedding))) AS k FROM cell))
SELECT slide_id, roi_id, k::INT AS k, {_q('sum(w * v) / sum(w)')} AS value FROM x GROUP BY ALL"""
)
def roi_embedding(spark, sf):
    t = fx.tiles(spark, sf)
    e = vectors.window_embeddings(_gated(spark, sf).where("passed_qc"), t, _features(spark, sf), R, 0.3, 64)
    return e.select("slide_id", "roi_id", F.posexplode("embedding").alias("k", "x")).select("slide_id", "roi_id", "k", sc.quantised("x").alias("value"))


def _points(spark, sf):
    return fx.vectors(spark, sf).select("slide_id", F.col("vec_id").cast("int").alias("roi_id"), "grid_i", "grid_j", "quality", "embedding")


@query(
    _with(V_, "u AS (SELECT vec_id, slide_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM vec)",
          "s AS (SELECT a.vec_id, max(list_dot_product(a.e, b.e) / (a.n * b.n)) AS s FROM u a JOIN u b ON b.slide_id = (a.slide_id + 1) % 10 GROUP BY a.vec_id)")
    + f"SELECT v.vec_id::INT AS roi_id, {_q('coalesce(s, 0)')} AS max_similarity, {_q('pow(0.05::DOUBLE + least(1, greatest(0, 1 - coalesce(s, 0))), 1.0::DOUBLE)')} AS novelty FROM vec v LEFT JOIN s USING (vec_id)"
)
def cosine_novelty(spark, sf):
    p = _points(spark, sf)
    history = p.select(((F.col("slide_id") + 9) % 10).alias("slide_id"), "embedding")
    return vectors.with_novelty(p, history).select("roi_id", sc.quantised("max_similarity").alias("max_similarity"), sc.quantised("novelty").alias("novelty"))


PAIRS = _with(
    V_,
    "pr AS (SELECT a.slide_id, a.vec_id::INT AS a, b.vec_id::INT AS b, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) AS d2, a.quality * b.quality AS qq, (a.grid_i - b.grid_i) * (a.grid_i - b.grid_i) + (a.grid_j - b.grid_j) * (a.grid_j - b.grid_j) AS p2 FROM vec a JOIN vec b ON a.slide_id = b.slide_id AND a.vec_id <> b.vec_id)",
    "sg AS (SELECT slide_id, coalesce(sqrt(median(CASE WHEN d2 > 0 THEN d2 END)), 1) AS sigma FROM pr GROUP BY slide_id)",
)


@query(PAIRS + f"SELECT slide_id, a, b, {_q('d2')} AS d2 FROM pr")
def pair_distance(spark, sf):
    return vectors.pair_distances(_points(spark, sf)).select("slide_id", F.col("a_roi_id").alias("a"), F.col("b_roi_id").alias("b"), sc.quantised("d2").alias("d2"))


@query(PAIRS + f"SELECT slide_id, {_q('sigma')} AS sigma FROM sg")
def median_sigma(spark, sf):
    return vectors.bandwidths(_points(spark, sf)).select("slide_id", sc.quantised("sigma").alias("sigma"))


@query(PAIRS + f"SELECT slide_id, a, b, {_q('qq * exp(-d2 / (sigma * sigma)) * exp(-p2 / (6::DOUBLE * 6::DOUBLE))')} AS value FROM pr JOIN sg USING (slide_id) UNION ALL SELECT slide_id, vec_id::INT, vec_id::INT, {_q('quality * quality + 1e-6::DOUBLE')} FROM vec")
def kernel_entries(spark, sf):
    return vectors.kernel_entries(_points(spark, sf), R).withColumn("value", sc.quantised("value"))


_D2 = "list_sum(list_transform(list_zip(v.embedding, {}.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query(
    _with(
        V_,
        "w AS (SELECT slide_id, vec_id, embedding, 1 / (1 + vec_id::DOUBLE) AS q FROM vec)",
        "p0 AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY q DESC) = 1)",
        f"d1 AS (SELECT v.*, {_D2.format('p')} AS m FROM w v JOIN p0 p ON p.slide_id = v.slide_id)",
        "p1 AS (SELECT * FROM d1 WHERE vec_id NOT IN (SELECT vec_id FROM p0) QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY m * q DESC, vec_id) = 1)",
        f"d2 AS (SELECT v.* EXCLUDE (m), least(v.m, {_D2.format('p')}) AS m FROM d1 v JOIN p1 p ON p.slide_id = v.slide_id)",
        "p2 AS (SELECT * FROM d2 WHERE vec_id NOT IN (SELECT vec_id FROM p0) AND vec_id NOT IN (SELECT vec_id FROM p1) QUALIFY row_number() OVER (PARTITION BY slide_id ORDER BY m * q DESC, vec_id) = 1)",
    )
    + "SELECT slide_id, vec_id::INT AS roi_id, 0 AS pick FROM p0 UNION ALL SELECT slide_id, vec_id::INT, 1 FROM p1 UNION ALL SELECT slide_id, vec_id::INT, 2 FROM p2"
)
def fps_select(spark, sf):
    return select.quality_farthest(_points(spark, sf).withColumn("quality", 1 / (1 + F.col("roi_id").cast("double"))), 3)


@query(_with(V_) + f", x AS (SELECT slide_id, grid_i, k, embedding[k + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS k FROM vec)) SELECT slide_id, grid_i, k::INT AS k, {_q('avg(v)')} AS value, count(*) AS n FROM x GROUP BY slide_id, grid_i, k")
def overlap_mean(spark, sf):
    out = vectors.overlap_mean(fx.vectors(spark, sf), ["slide_id", "grid_i"], "embedding")
    return out.select("slide_id", "grid_i", "n", F.posexplode("target").alias("k", "x")).select("slide_id", "grid_i", "k", sc.quantised("x").alias("value"), "n")


@query(_with(V_) + f", x AS (SELECT slide_id, quality > 0.5 AS ok, k, embedding[k + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS k FROM vec)) SELECT slide_id, k::INT AS k, {_q('sum(CASE WHEN ok THEN v ELSE 0 END) / greatest(1, count(*) FILTER (WHERE ok))')} AS value FROM x GROUP BY slide_id, k")
def masked_pool(spark, sf):
    out = vectors.masked_mean(fx.vectors(spark, sf).withColumn("ok", F.col("quality") > 0.5), ["slide_id"], "embedding", "ok")
    return out.select("slide_id", F.posexplode("pooled").alias("k", "x")).select("slide_id", "k", sc.quantised("x").alias("value"))


@query(_with(V_) + ", x AS (SELECT vec_id, k, embedding[k + 1] AS v FROM (SELECT *, unnest(range(len(embedding))) AS k FROM vec)) SELECT vec_id, k::INT AS class_id FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) = 1")
def argmax_class(spark, sf):
    x = fx.vectors(spark, sf).select("vec_id", F.posexplode("embedding").alias("class_id", "score"))
    return vectors.best_class(x, ["vec_id"], "class_id", "score")


# ---------------------------------------------------------------- labels and views


@query(_with(G_) + f", n(class_id, name, r, g, b) AS (VALUES {', '.join(repr(c) for c in views.CLASSES)}) SELECT tile_id, class_id, name, CASE WHEN class_id BETWEEN 2 AND 6 THEN r ELSE 0 END AS r, CASE WHEN class_id BETWEEN 2 AND 6 THEN g ELSE 0 END AS g, CASE WHEN class_id BETWEEN 2 AND 6 THEN b ELSE 0 END AS b, coalesce(class_id BETWEEN 2 AND 6 AND name IS NOT NULL, FALSE) AS is_artifact FROM (SELECT tile_id, (size % 9)::INT AS class_id FROM grid) LEFT JOIN n USING (class_id)")
def label_colour(spark, sf):
    return views.coloured(fx.tiles(spark, sf).select("tile_id", (F.col("size") % 9).alias("class_id")), artifacts_only=True)


@query(_with(G_) + ", l AS (SELECT slide_id, grid_i, grid_j, tissue_frac, (size % 7)::INT AS c, min(size % 7) OVER (PARTITION BY slide_id, grid_i) AS lo, max(size % 7) OVER (PARTITION BY slide_id, grid_i) AS hi FROM grid) SELECT slide_id, grid_i, grid_j, CASE WHEN tissue_frac < 0.2 OR c + CASE WHEN lo = 0 AND hi = 6 THEN 1 ELSE 0 END = 0 THEN 7 ELSE c + CASE WHEN lo = 0 AND hi = 6 THEN 1 ELSE 0 END END AS class_id FROM l")
def aligned_labels(spark, sf):
    l = fx.tiles(spark, sf).withColumn("class_id", F.col("size") % 7)
    return views.aligned_labels(l, ["slide_id", "grid_i"], "class_id", F.col("tissue_frac") >= 0.2).select("slide_id", "grid_i", "grid_j", "class_id")


@query(_with(G_) + "SELECT slide_id, (grid_i // 5)::INT AS block, count(*) FILTER (WHERE tissue_frac >= 0.5) AS n_tissue FROM grid GROUP BY ALL HAVING n_tissue > 50")
def tissue_blocks(spark, sf):
    px = fx.tiles(spark, sf).withColumn("block", F.floor(F.col("grid_i") / 5).cast("int")).withColumn("t", F.col("tissue_frac") >= 0.5)
    return views.blocks_with_tissue(px, ["slide_id", "block"], "t")


@query(_with(G_) + "SELECT slide_id, (grid_i - 2)::INT AS y, (grid_j - 3)::INT AS x, size AS class_id FROM grid WHERE grid_i BETWEEN 2 AND 7 AND grid_j BETWEEN 3 AND 16")
def stitched_labels(spark, sf):
    b = fx.tiles(spark, sf).select("slide_id", (F.floor(F.col("grid_i") / 4) * 4).cast("int").alias("y0"), (F.floor(F.col("grid_j") / 4) * 4).cast("int").alias("x0"), (F.col("grid_i") % 4).alias("y"), (F.col("grid_j") % 4).alias("x"), F.col("size").alias("class_id"))
    return views.stitched(b, (2, 3, 8, 17))


_CROP = 6


@query(
    _with(G_, f"""cr AS (SELECT slide_id, v AS view, least(floor({_u("slide_id::VARCHAR || '/local/' || v::VARCHAR || '/r'")} * {N_ROWS - _CROP + 1}), {N_ROWS - _CROP})::INT AS r0, least(floor({_u("slide_id::VARCHAR || '/local/' || v::VARCHAR || '/c'")} * {N_COLS - _CROP + 1}), {N_COLS - _CROP})::INT AS c0 FROM (SELECT DISTINCT slide_id FROM grid), range(10) t(v))""",
          f"cl AS (SELECT slide_id, view, r0, c0, r0 + i AS grid_i, c0 + j AS grid_j, i, j FROM cr, range({_CROP}) a(i), range({_CROP}) b(j))")
    + f"""SELECT cl.slide_id, view::INT AS view, i::INT AS i, j::INT AS j, cl.grid_i::INT AS grid_i, cl.grid_j::INT AS grid_j, g.tissue_frac >= 0.3 AS valid, g.tissue_frac >= 0.3 AND {_u("cl.slide_id::VARCHAR || '/' || view::VARCHAR || '/' || i::VARCHAR || '/' || j::VARCHAR")} < 0.45 AS masked
 FROM cl JOIN grid g ON g.slide_id = cl.slide_id AND g.grid_i = cl.grid_i AND g.grid_j = cl.grid_j"""
)
def crop_mask(spark, sf):
    t = fx.tiles(spark, sf)
    crops = views.crop_positions(t.select("slide_id").distinct(), "slide_id", N_ROWS, N_COLS, _CROP, 10, "local")
    cells = views.crop_cells(crops, "slide_id", _CROP).join(t.select("slide_id", "grid_i", "grid_j", (F.col("tissue_frac") >= 0.3).alias("valid")), ["slide_id", "grid_i", "grid_j"])
    key = F.concat_ws("/", *(F.col(c).cast("string") for c in ("slide_id", "view", "i", "j")))
    return views.masked_cells(cells, key, 0.45).select("slide_id", "view", "i", "j", "grid_i", "grid_j", "valid", "masked")


@query(_with(G_, f"""cr AS (SELECT slide_id, v AS view, CASE WHEN v = 0 THEN 0 ELSE 2 END AS r0, CASE WHEN (v = 0) = ({_u("slide_id::VARCHAR || '/global/diagonal'")} < 0.5) THEN 0 ELSE 4 END AS c0 FROM (SELECT DISTINCT slide_id FROM grid), range(2) t(v))""") + "SELECT slide_id, 'global' AS view_type, view::INT AS view, r0, c0 FROM cr")
def corner_crops(spark, sf):
    return views.crop_positions(fx.tiles(spark, sf).select("slide_id").distinct(), "slide_id", 10, 12, 8, 2, "global", corners=True)


@query(_with(S_) + "SELECT series_id, (row_number() OVER (ORDER BY md5(series_id::VARCHAR || ':0:3'), series_id) - 1)::BIGINT AS position, ((row_number() OVER (ORDER BY md5(series_id::VARCHAR || ':0:3'), series_id) - 1) // 32)::BIGINT AS batch FROM series")
def batch_slices(spark, sf):
    return views.batches(fx.series(spark, sf).select("series_id"), "series_id", 32, 3)


@query(None)
def augmented_crops(spark, sf):
    t = fx.tiles(spark, sf).select("slide_id", "grid_i", "grid_j", (F.col("tissue_frac") >= 0.3).alias("valid"))
    crops = views.crop_positions(t.select("slide_id").distinct(), "slide_id", N_ROWS, N_COLS, _CROP, 10, "local")
    cells = views.crop_cells(crops, "slide_id", _CROP).join(t, ["slide_id", "grid_i", "grid_j"]).join(_features(spark, sf), ["slide_id", "grid_i", "grid_j"])
    return views.augmented(cells, _CROP, F.concat_ws("/", F.col("slide_id").cast("string"), F.col("view").cast("string"))).select("slide_id", "view", "i", "j", "valid", "features")


@query(None)
def train_views(spark, sf):
    """The views of one epoch from the windows that each grid's sample holds."""
    c = _gated(spark, sf).withColumn("pick", F.when(F.col("roi_id") == 3, 0).when(F.col("roi_id") == 5, 1))
    return jobs.train_views(c, fx.tiles(spark, sf).drop("tile_id", "size"), _features(spark, sf), R, epoch=2, sizes=(3, 2), counts=(2, 4))


PAIRED = ORDERED.rstrip() + ",\n" + FEATURES + f""",
two AS (SELECT slide_id, max(CASE WHEN roi_id = 0 THEN grid_i END) AS ai, max(CASE WHEN roi_id = 0 THEN grid_j END) AS aj, max(CASE WHEN roi_id = 1 THEN grid_i END) AS bi, max(CASE WHEN roi_id = 1 THEN grid_j END) AS bj FROM ord GROUP BY slide_id),
side AS (SELECT slide_id, 'a' AS side, ai AS i0, aj AS j0 FROM two UNION ALL SELECT slide_id, 'b', bi, bj FROM two),
pc AS (SELECT s.slide_id, side, i, j, h.t >= 0.3 AS valid, f.embedding FROM side s, range({R}) x(i), range({R}) y(j) JOIN h ON h.slide_id = s.slide_id AND h.grid_i = i0 + i AND h.grid_j = j0 + j JOIN ft f ON f.slide_id = h.slide_id AND f.grid_i = h.grid_i AND f.grid_j = h.grid_j)
"""


@query(PAIRED + "SELECT slide_id, side, i::INT AS i, j::INT AS j, valid, k::INT AS k, CASE WHEN valid THEN embedding[k + 1]::DOUBLE ELSE 0::DOUBLE END AS value FROM (SELECT *, unnest(range(len(embedding))) AS k FROM pc)")
def paired_windows(spark, sf):
    o = _ordered(spark, sf)
    at = lambda n, c: F.max(F.when(F.col("roi_id") == n, F.col(c)))
    two = o.groupBy("slide_id").agg(at(0, "grid_i").alias("a_i"), at(0, "grid_j").alias("a_j"), at(1, "grid_i").alias("b_i"), at(1, "grid_j").alias("b_j"))
    out = views.paired_windows(two, _features(spark, sf), fx.tiles(spark, sf), R, 0.3)
    return out.select("slide_id", "side", "i", "j", "valid", F.posexplode("features").alias("k", "x")).select("slide_id", "side", "i", "j", "valid", "k", F.abs(F.col("x").cast("double")).alias("m"), F.col("x").cast("double").alias("value")).select("slide_id", "side", "i", "j", "valid", "k", F.when(F.col("m") == 0, F.lit(0.0)).otherwise(F.col("value")).alias("value"))


@query(_with(V_) + "SELECT slide_id, min(quality) AS min_quality, max(quality) AS max_quality, min(vec_id) AS min_vec_id, max(vec_id) AS max_vec_id FROM vec GROUP BY slide_id")
def quality_extremes(spark, sf):
    return vectors.extremes(fx.vectors(spark, sf), ["quality", "vec_id"])


@query(
    _with(V_, "b AS (SELECT slide_id, vec_id, embedding, row_number() OVER (PARTITION BY slide_id ORDER BY vec_id DESC) - 1 AS back FROM vec)",
          "x AS (SELECT slide_id, back, k, embedding[k + 1]::DOUBLE AS v FROM (SELECT *, unnest(range(len(embedding))) AS k FROM b))")
    + f"SELECT slide_id, k::INT AS k, {_q('sum(v * 0.1::DOUBLE * pow(0.9::DOUBLE, back))')} AS value FROM x GROUP BY slide_id, k"
)
def running_centre(spark, sf):
    v = fx.vectors(spark, sf)
    width = v.select(F.max(F.size("embedding"))).first()[0]
    out = vectors.running_centre(v, "slide_id", "vec_id", "embedding", 0.9, [0.0] * width)
    return out.select("slide_id", F.posexplode("centre").alias("k", "x")).select("slide_id", "k", sc.quantised("x").alias("value"))


@query(
    _with(V_, "p AS (SELECT vec_id, slide_id, embedding::DOUBLE[] AS e, list_max(embedding::DOUBLE[]) AS top FROM vec WHERE quality > 0.5)",
          "t AS (SELECT vec_id, slide_id, e, top, list_sum(list_transform(e, lambda x: exp((x - top) / 0.4::DOUBLE))) AS zt, ln(list_sum(list_transform(e, lambda x: exp((x - top) / 1.0::DOUBLE)))) AS zs FROM p)",
          "l AS (SELECT slide_id, -list_sum(list_transform(e, lambda x: exp((x - top) / 0.4::DOUBLE) / zt * ((x - top) / 1.0::DOUBLE - zs))) AS l FROM t)")
    + f"SELECT slide_id, {_q('avg(l)', 5)} AS loss, count(*) AS n FROM l GROUP BY slide_id"
)
def masked_divergence(spark, sf):
    v = fx.vectors(spark, sf).withColumn("masked", F.col("quality") > 0.5)
    out = views.masked_divergence(v, "embedding", "embedding", "masked", ["slide_id"], 0.4, 1.0)
    return out.select("slide_id", sc.quantised("loss", 5).alias("loss"), "n")


@query(_with(G_) + "SELECT tile_id, floor((size * 5) * 0.299::DOUBLE + (tile_id % 256) * 0.587::DOUBLE + (grid_j * 12) * 0.114::DOUBLE + 0.5::DOUBLE)::INT AS grey, CASE WHEN greatest(size * 5, tile_id % 256, grid_j * 12) > 0 THEN floor((greatest(size * 5, tile_id % 256, grid_j * 12) - least(size * 5, tile_id % 256, grid_j * 12)) * 255::DOUBLE / greatest(size * 5, tile_id % 256, grid_j * 12) + 0.5::DOUBLE)::INT ELSE 0 END AS saturation FROM grid")
def grey_and_saturation(spark, sf):
    r, g, b = F.col("size") * 5, F.col("tile_id") % 256, F.col("grid_j") * 12
    return fx.tiles(spark, sf).select("tile_id", sc.luminance(r, g, b).alias("grey"), sc.saturation(r, g, b).alias("saturation"))


@query("SELECT c_custkey, list_filter(list_transform(string_split(replace(c_name, '#', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> '')[1] AS first, len(list_filter(list_transform(string_split(replace(c_name, '#', ' , ,'), ','), lambda x: trim(x)), lambda x: x <> '')) AS n, CASE WHEN c_acctbal > 0 THEN c_acctbal * 1000 END AS um FROM customer")
def comma_list(spark, sf):
    c = fx.table(spark, sf, "customer")
    parts = sc.comma_list(F.replace("c_name", F.lit("#"), F.lit(" , ,")))
    return c.select("c_custkey", F.get(parts, 0).alias("first"), F.size(parts).cast("long").alias("n"), sc.micrometres("c_acctbal").alias("um"))


@query(_with(G_, V_, "y AS (SELECT slide_id, grid_i, grid_j, max(quality) AS teacher FROM vec GROUP BY ALL)") + "SELECT slide_id, grid_i, grid_j, tissue_frac AS student, teacher FROM grid JOIN y USING (slide_id, grid_i, grid_j)")
def student_targets(spark, sf):
    x = fx.tiles(spark, sf).select("slide_id", "grid_i", "grid_j", F.col("tissue_frac").alias("student"))
    y = fx.vectors(spark, sf).groupBy("slide_id", "grid_i", "grid_j").agg(F.max("quality").alias("teacher"))
    return views.student_targets(x, y, ["slide_id", "grid_i", "grid_j"])


# ---------------------------------------------------------------- encoding, stores, whole jobs

NEEDED = ORDERED.rstrip() + f""",
need AS (SELECT DISTINCT h.slide_id, h.grid_i, h.grid_j FROM gated o JOIN h ON h.slide_id = o.slide_id AND h.grid_i BETWEEN o.grid_i AND o.grid_i + {R - 1} AND h.grid_j BETWEEN o.grid_j AND o.grid_j + {R - 1} WHERE o.passed_qc AND h.t >= 0.3),
store AS (SELECT slide_id, grid_i, grid_j FROM grid WHERE size % 2 = 0)
"""


def _store(spark, sf):
    t = fx.tiles(spark, sf)
    store = t.select("slide_id", "grid_i", "grid_j", (F.col("size") % 2 == 0).alias("valid"))
    return t, store


@query(NEEDED + "SELECT * FROM need ANTI JOIN store USING (slide_id, grid_i, grid_j)")
def incremental_encode(spark, sf):
    t, store = _store(spark, sf)
    return jobs.encode_missing(_gated(spark, sf).where("passed_qc"), t, store, R, 0.3)[0]


@query(NEEDED + "SELECT n.slide_id, count(*) AS requested, count(s.slide_id) AS already, count(*) - count(s.slide_id) AS now FROM need n LEFT JOIN store s USING (slide_id, grid_i, grid_j) GROUP BY n.slide_id")
def encode_stats(spark, sf):
    t, store = _store(spark, sf)
    return jobs.encode_missing(_gated(spark, sf).where("passed_qc"), t, store, R, 0.3)[1]


@query(_with(G_, FEATURES) + f", x AS (SELECT slide_id, grid_i, grid_j, embedding, unnest(range(len(embedding))) AS k FROM ft) SELECT x.slide_id, (x.grid_i // 16)::INT AS block_i, (x.grid_j // 16)::INT AS block_j, x.grid_i, x.grid_j, k::INT AS k, CASE WHEN g.tissue_frac >= 0.3 THEN {_half('embedding[k + 1]::DOUBLE')} ELSE 0 END AS value, g.tissue_frac >= 0.3 AS valid FROM x JOIN grid g USING (slide_id, grid_i, grid_j)")
def feature_store(spark, sf):
    rows = _features(spark, sf).join(fx.tiles(spark, sf).select("slide_id", "grid_i", "grid_j", "tissue_frac"), ["slide_id", "grid_i", "grid_j"])
    kept = encode.stored_features(rows, 64, valid=F.col("tissue_frac") >= 0.3)
    path = scratch_path(spark, "features")
    sinks.write_features(kept, path)
    from gridloom.schemas import FEATURE_GRID

    back = readers.read_table(spark, path, FEATURE_GRID).withColumn("slide_id", F.col("slide_id").cast(kept.schema["slide_id"].dataType))
    return back.select("slide_id", "block_i", "block_j", "grid_i", "grid_j", "valid", F.posexplode("features").alias("k", "x")).select("slide_id", "block_i", "block_j", "grid_i", "grid_j", "k", F.col("x").cast("double").alias("value"), "valid")


@query(_with(G_) + "SELECT slide_id, grid_i, grid_j, CASE WHEN size >= 25 THEN -size ELSE size END AS size FROM grid")
def store_upsert(spark, sf):
    t = fx.tiles(spark, sf).select("slide_id", "grid_i", "grid_j", "size")
    return encode.upserted(t, encode.unique_cells(t.where("size >= 25").withColumn("size", -F.col("size"))))


@query(_with(G_) + "SELECT slide_id, grid_i, grid_j, tissue_frac FROM grid WHERE grid_i BETWEEN 2 AND 6 AND grid_j BETWEEN 5 AND 14")
def grid_rectangle(spark, sf):
    return readers.grid_rectangle(fx.tiles(spark, sf), (2, 7), (5, 15)).select("slide_id", "grid_i", "grid_j", "tissue_frac")


@query(TILED + "SELECT slide_id::VARCHAR AS slide_id, tile_id, grid_i, grid_j, x0_lvl0, y0_lvl0, x1_lvl0, y1_lvl0, tissue_frac, artifact_frac, rejected, reject_reason FROM judged")
def tile_manifest(spark, sf):
    path = scratch_path(spark, "tiles")
    sinks.write_tile_manifest(_tiled(spark, sf).withColumn("slide_id", F.col("slide_id").cast("string")), path)
    from gridloom.schemas import TILE_MANIFEST

    return readers.read_table(spark, path, TILE_MANIFEST)


@query(_with(S_) + "SELECT series_id::VARCHAR AS slide_id, patient_id::VARCHAR AS patient_id, 'kept' AS note, site FROM series")
def metadata_document(spark, sf):
    s = fx.series(spark, sf).select(F.col("series_id").cast("string").alias("slide_id"), "patient_id", "site", F.create_map(F.lit("note"), F.lit("kept"), F.lit("site"), F.lit("never")).alias("extra"))
    doc = sinks.metadata_json(s)
    part = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return doc.select(readers.slide_id_of(F.col("metadata"), F.lit("x/y")).alias("slide_id"), part("patient_id"), part("note"), part("site"))


@query(_with(V_) + "SELECT vec_id, k::INT AS k, CAST(cos(list_sum(embedding::DOUBLE[]) / len(embedding) * (k + 1)) AS FLOAT)::DOUBLE AS value FROM vec, range(8) t(k)")
def predict_udf_smoke(spark, sf):
    udf = encode.encoder_udf(encode.stand_in_encoder(8), 8, shape=[64])
    v = fx.vectors(spark, sf).select("vec_id", udf(F.col("embedding")).alias("f"))
    return v.select("vec_id", F.posexplode("f").alias("k", "x")).select("vec_id", "k", F.col("x").cast("double").alias("value"))


@query(None)
def diverse_select(spark, sf):
    p = _points(spark, sf).withColumn("group_id", F.col("roi_id") % 3)
    return select.select_diverse(p, 4, R, method="fps")


@query(None)
def kdpp_select(spark, sf):
    p = _points(spark, sf).withColumn("group_id", F.col("roi_id") % 3)
    return select.select_diverse(p, 4, R, method="kdpp")


@query(None)
def sample_rois(spark, sf):
    t = fx.tiles(spark, sf).drop("tile_id", "size")
    return jobs.sample_rois(t, _features(spark, sf), 3, k=2, target=16, width=64, least_tissue=0.4, radius=1, cover=0.6)


@query(ORDERED + """, c AS (SELECT *, CASE WHEN roi_id = 3 THEN 1 WHEN roi_id = 5 THEN 0 END AS pick FROM gated),
d AS (SELECT slide_id, 'passed' AS kind, row_number() OVER (PARTITION BY slide_id ORDER BY roi_id) - 1 AS place, roi_id, grid_i, grid_j, tissue_frac, artifact_frac FROM c WHERE passed_qc
 UNION ALL SELECT slide_id, 'selected', row_number() OVER (PARTITION BY slide_id ORDER BY pick) - 1, roi_id, grid_i, grid_j, tissue_frac, artifact_frac FROM c WHERE pick IS NOT NULL)
SELECT slide_id, 3 AS roi_size, kind, place::INT AS place, roi_id, grid_i, grid_j, tissue_frac, artifact_frac FROM d""")
def samples_document(spark, sf):
    r = F.col("roi_id")
    c = _gated(spark, sf).withColumn("pick", F.when(r == 3, 1).when(r == 5, 0)).withColumn("group_id", F.lit(None).cast("int"))
    doc = sinks.samples_document(c, 3)
    rows = [doc.select("slide_id", "roi_size", F.lit(kind).alias("kind"), F.posexplode(f"{kind}_candidates").alias("place", "c")) for kind in ("passed", "selected")]
    return rows[0].unionByName(rows[1]).select("slide_id", "roi_size", "kind", "place", "c.roi_id", "c.grid_i", "c.grid_j", "c.tissue_frac", "c.artifact_frac")


def _images(spark, sf):
    """Grey thumbnails of the grids: a pixel for each cell, white where there is none."""
    size = F.map_from_entries(F.collect_list(F.struct((F.col("grid_i") * N_COLS + F.col("grid_j")).alias("at"), "size")))
    cells = fx.tiles(spark, sf).groupBy("slide_id").agg((F.max("grid_i") + 1).alias("height"), size.alias("m"))
    greys = F.transform(F.sequence(F.lit(0), F.col("height") * N_COLS - 1), lambda at: F.lpad(F.hex(255 - F.coalesce(F.try_element_at("m", at), F.lit(0)) * 5), 2, "0"))
    rgb = F.unhex(F.regexp_replace(F.array_join(greys, ""), "(..)", "$1$1$1"))
    return cells.select(F.col("slide_id").cast("string").alias("slide_id"), "height", F.lit(N_COLS).alias("width"), rgb.alias("rgb"))


@query(None)
def tissue_masks(spark, sf):
    return grid.tissue_masks(_images(spark, sf), 3, 4)


@query(_with(G_) + f"""SELECT slide_id::VARCHAR AS slide_id, t.tile_id, avg(CASE WHEN coalesce(g.size, 0) >= 20 THEN 1.0::DOUBLE ELSE 0 END) AS fraction
 FROM (SELECT slide_id, max(grid_i) + 1 AS h FROM grid GROUP BY slide_id) s, (SELECT i * 5 + j AS tile_id, i * 3 AS i0, j * 4 AS j0 FROM range(4) a(i), range(5) b(j)) t, range(3) c(di), range(4) d(dj)
 LEFT JOIN grid g ON g.slide_id = s.slide_id AND g.grid_i = i0 + di AND g.grid_j = j0 + dj WHERE i0 + di < h GROUP BY ALL""".replace("SELECT slide_id::VARCHAR AS slide_id, t", "SELECT s.slide_id::VARCHAR AS slide_id, t"))
def packed_fractions(spark, sf):
    import numpy as np

    images = _images(spark, sf)

    def dark(frames):
        for pdf in frames:
            yield pdf.assign(tissue=[np.packbits(np.frombuffer(x, np.uint8)[::3] <= 155).tobytes() for x in pdf.rgb])[["slide_id", "height", "width", "tissue"]]

    masks = images.mapInPandas(dark, "slide_id string, height int, width int, tissue binary")
    tiles = images.select("slide_id", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("tile_id"), "height").withColumn("tile_id", F.col("tile_id").cast("long"))
    i, j = F.floor(F.col("tile_id") / 5) * 3, F.col("tile_id") % 5 * 4
    boxes = tiles.select("slide_id", "tile_id", j.alias("x0_lvl0"), (j + 4).alias("x1_lvl0"), i.alias("y0_lvl0"), (i + 3).alias("y1_lvl0"), F.lit(1.0).alias("scale_x"), F.lit(1.0).alias("scale_y"), "height").where("y0_lvl0 < height")
    return grid.packed_fractions(boxes, masks, "tissue", "fraction").select("slide_id", "tile_id", "fraction")


@query(None)
def artifact_masks(spark, sf):
    """Artifacts of the grids' thumbnails by the stand-in segmenter; the slides are arrays made from the path."""
    images = _images(spark, sf)
    masks = grid.tissue_masks(images, 3, 4).select("slide_id", "height", "width", "tissue")
    slides = masks.select("slide_id", F.concat(F.lit("grid-"), "slide_id").alias("slide_path"), F.lit(1.5).alias("mpp"), "height", "width", "tissue")
    found = segment.artifact_masks(slides, segment.stand_in_segmenter(), {"": _striped}, patch=8, least=2, batch=3)
    return found.select("slide_id", "height", "width", F.hex("artifact").alias("artifact"), "patches", "patches_read")


def _striped(path: str):
    import numpy as np

    pixels = np.zeros((N_ROWS, N_COLS, 3), np.uint8)
    pixels[:, ::2, 1] = 200
    return readers.ArraySlide(pixels)


@query(_with(S_) + "SELECT site, count(*) AS n FROM series GROUP BY site")
def streaming_ingest(spark, sf):
    source, out, marks = (scratch_path(spark, f"stream-{n}") for n in ("in", "out", "marks"))
    rows = fx.series(spark, sf)
    rows.repartition(4, "series_id").write.parquet(source)
    ingest.process_available(ingest.new_files(spark, source, rows.schema, 2), lambda b: b.groupBy("site").count(), out, marks).awaitTermination()
    return spark.read.parquet(out).groupBy("site").agg(F.sum("count").alias("n"))
