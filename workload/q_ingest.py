"""Columns, validation, joins and region tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.functions import columns as C
from cytoplane.operators import composition, ingest
from cytoplane.session import shared_folder
from cytoplane.settings import IMMUNE_TYPES, PrepareSettings, ROLE_TERMS, TUMOR_STROMA_TYPES, VASCULAR_TYPES
from cytoplane.sources import image_folder, raster
from workload import views as V
from workload.registry import query, with_views


def r6(column, name):
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def names(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


@query(
    "flagship_region_composition",
    with_views(
        V.CELLS_SQL,
        V.REGIONS_SQL,
        """e AS (SELECT region_id, CAST(count(*) AS DOUBLE) AS cell_count,
             greatest((max(x) - min(x)) * (max(y) - min(y)), 1e-6::DOUBLE) AS bbox_area FROM cells GROUP BY 1),
        p AS (SELECT region_id, cell_type, count(*) AS n FROM cells GROUP BY 1, 2)
        SELECT p.region_id, r.label, p.cell_type, round(n / cell_count, 6) + 0.0::DOUBLE AS share,
               round(cell_count / bbox_area, 6) + 0.0::DOUBLE AS density
        FROM p JOIN e USING (region_id) LEFT JOIN regions r USING (region_id)""",
    ),
)
def flagship(spark, sf):
    cells = V.cells(spark, sf)
    extent = composition.extent(cells)
    shares = cells.groupBy("region_id", "cell_type").agg(F.count("*").alias("n"))
    joined = ingest.join_labels(shares.join(extent, "region_id"), V.regions(spark, sf))
    return joined.select(
        "region_id", "label", "cell_type", r6(F.col("n") / F.col("cell_count"), "share"), r6(F.col("cell_density"), "density")
    )


RAW_TABLES = ("events", "customer", "lineitem")


@query(
    "p1_required_columns",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS table_name, column_name AS missing, (SELECT count(*) FROM {t}) AS row_count
       FROM (VALUES ('cell_id'), ('cell_type'), ('patient_id'), ('region_id'), ('sample_id'), ('x'), ('y')) v(column_name)
       WHERE column_name NOT IN (SELECT DISTINCT unnest(json_keys(to_json(e))) FROM {t} e)"""
        for t in RAW_TABLES
    ),
)
def required_columns(spark, sf):
    """Which required columns each raw table lacks, and its rows."""
    parts = []
    for name in RAW_TABLES:
        rows = V.table(spark, sf, name)
        counted = rows.agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name))
        parts.append(counted.select("table_name", F.explode(F.lit(ingest.missing_columns(rows))).alias("missing"), "row_count"))
    return reduce(DataFrame.unionByName, parts)


@query("p2_duplicate_cell_ids", "SELECT l_orderkey AS cell_id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_cell_ids(spark, sf):
    return ingest.duplicate_ids(V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("cell_id")))


RAW_PATIENT = """CASE c_custkey % 7 WHEN 0 THEN CAST(c_custkey AS VARCHAR) || '.0' WHEN 1 THEN ' p' || CAST(c_custkey AS VARCHAR)
  WHEN 2 THEN 'P00' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN CAST(c_custkey AS VARCHAR) WHEN 4 THEN 'X' || CAST(c_custkey AS VARCHAR)
  WHEN 5 THEN 'P' || CAST(c_custkey AS VARCHAR) || '.0' ELSE 'p' || CAST(c_custkey AS VARCHAR) || '_a' END"""


def patient_sql(text: str) -> str:
    cleaned = f"regexp_replace(trim({text}), '^(\\d+)\\.0$', '\\1')"
    number = f"CAST(regexp_extract({cleaned}, '^[Pp]?(\\d+)$', 1) AS BIGINT)"
    return f"""CASE WHEN regexp_matches({cleaned}, '^[Pp]?\\d+$')
      THEN 'P' || CASE WHEN {number} < 10 THEN '0' ELSE '' END || CAST({number} AS VARCHAR) ELSE {cleaned} END"""


@query("p3_patient_ids", f"SELECT c_custkey, {patient_sql('(' + RAW_PATIENT + ')')} AS patient_id FROM customer")
def patient_ids(spark, sf):
    customer = V.table(spark, sf, "customer")
    return customer.select("c_custkey", C.patient_id(F.expr(RAW_PATIENT.replace("VARCHAR", "STRING"))).alias("patient_id"))


@query(
    "p4_patient_of_sample",
    f"SELECT c_custkey, {patient_sql('split_part((' + RAW_PATIENT + '), ' + chr(39) + '_' + chr(39) + ', 1)')} AS patient_id FROM customer",
)
def patient_of_sample(spark, sf):
    customer = V.table(spark, sf, "customer")
    return customer.select("c_custkey", C.patient_of_sample(F.expr(RAW_PATIENT.replace("VARCHAR", "STRING"))).alias("patient_id"))


TYPED_SQL = f"""typed AS (SELECT event_id AS cell_id, user_id AS region_id, user_id % 25 AS patient_no,
  {V._case('event_type', V.EVENT_TO_RASTER_TYPE, "'Unknown'")} AS cell_type FROM events)"""


def typed_cells(spark, sf):
    """Cells named through the raster dictionary, with one type missing from it."""
    events = V.table(spark, sf, "events").select(
        F.col("event_id").alias("cell_id"), F.col("user_id").alias("region_id"), F.col("event_type").alias("cell_type_id"),
        (F.col("user_id") % 25).alias("patient_no"),
    )
    dictionary = (
        V.table(spark, sf, "events").select(F.col("event_type").alias("cell_type_id")).distinct()
        .withColumn("cell_type", F.expr(V._case("cell_type_id", V.EVENT_TO_RASTER_TYPE)))
        .where(F.col("cell_type").isNotNull())
    )
    return ingest.name_types(events, dictionary)


@query("j3_type_names", with_views(TYPED_SQL, "SELECT cell_id, cell_type FROM typed"))
def type_names(spark, sf):
    return typed_cells(spark, sf).select("cell_id", "cell_type")


@query(
    "p5_compartments",
    with_views(
        TYPED_SQL,
        f"""SELECT cell_id, CASE WHEN cell_type = 'Tumor' THEN 'tumor' WHEN cell_type = 'Stroma' THEN 'stroma'
            WHEN cell_type IN ({names(IMMUNE_TYPES)}) THEN 'immune' WHEN cell_type IN ({names(VASCULAR_TYPES)}) THEN 'vascular'
            WHEN cell_type = 'Neuron' THEN 'neural' ELSE 'other' END AS compartment FROM typed""",
    ),
)
def compartments(spark, sf):
    return typed_cells(spark, sf).select("cell_id", C.compartment(F.col("cell_type")).alias("compartment"))


@query(
    "p6_patch_regions",
    with_views(
        V.PIXELS_SQL,
        """SELECT sample_id || '_patch_' || CAST(CAST(floor(x * 20 / 256) AS BIGINT) AS VARCHAR) || '_' ||
                  CAST(CAST(floor(y * 100 / 256) AS BIGINT) AS VARCHAR) AS region_id, count(*) AS n
           FROM pixels GROUP BY 1""",
    ),
)
def patch_regions(spark, sf):
    key = C.patch_region(F.col("sample_id"), F.col("x") * 20, F.col("y") * 100)
    return V.pixels(spark, sf).groupBy(key.alias("region_id")).agg(F.count("*").alias("n"))


OBJECTS_SQL = """objects AS (SELECT sample_id, cell_no, count(*) AS n_pixels, avg(x) AS x, avg(y) AS y, avg(price) AS price,
  avg(discount) AS discount, avg(tax) AS tax FROM pixels WHERE cell_no > 0 GROUP BY 1, 2)"""


@query(
    "a1_pixels_to_cells",
    with_views(
        V.PIXELS_SQL, OBJECTS_SQL,
        """SELECT sample_id, cell_no, n_pixels, round(x, 6) AS x, round(y, 6) AS y, round(price, 4) AS marker_price,
           round(discount, 6) AS marker_discount, round(tax, 6) AS marker_tax FROM objects""",
    ),
)
def pixels_to_cells(spark, sf):
    cells = ingest.cells_from_pixels(V.pixels(spark, sf), ["price", "discount", "tax"])
    return cells.select(
        "sample_id", "cell_no", "n_pixels", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"),
        F.round("marker_price", 4).alias("marker_price"), F.round("marker_discount", 6).alias("marker_discount"),
        F.round("marker_tax", 6).alias("marker_tax"),
    )


RASTER_TYPES = ("Tumor", "Stroma", IMMUNE_TYPES[0], VASCULAR_TYPES[0], "Neuron")
_RASTER_TYPE = " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(RASTER_TYPES))


@query(
    "s6_raster_cells",
    with_views(
        V.PIXELS_SQL, OBJECTS_SQL,
        f"""named AS (SELECT *, CASE cell_no % 7 - 1 {_RASTER_TYPE} ELSE 'Unknown' END AS cell_type FROM objects WHERE cell_no % 7 - 1 >= 0),
        raster AS (SELECT sample_id || '_cell_' || CAST(cell_no AS VARCHAR) AS cell_id, sample_id,
          'P' || CASE WHEN length(sample_id) < 2 THEN '0' ELSE '' END || sample_id AS patient_id,
          sample_id || '_patch_' || CAST(CAST(floor(x / 16) AS BIGINT) AS VARCHAR) || '_' || CAST(CAST(floor(y / 16) AS BIGINT) AS VARCHAR) AS region_id,
          round(x, 6) AS x, round(y, 6) AS y, cell_type, CASE WHEN cell_type = 'Tumor' THEN 'tumor' WHEN cell_type = 'Stroma' THEN 'stroma'
            WHEN cell_type IN ({names(IMMUNE_TYPES)}) THEN 'immune' WHEN cell_type IN ({names(VASCULAR_TYPES)}) THEN 'vascular'
            WHEN cell_type = 'Neuron' THEN 'neural' ELSE 'other' END AS compartment,
          round(price, 4) AS marker_price, round(discount, 6) AS marker_discount, round(tax, 6) AS marker_tax FROM named)
        SELECT * FROM raster WHERE region_id IN (SELECT region_id FROM raster GROUP BY 1 HAVING count(*) >= 10)""",
    ),
)
def raster_cells(spark, sf):
    """Pixels with channels, labels of their objects and a dictionary as typed cells of large patches."""
    channels = ["price", "discount", "tax"]
    pixels = V.pixels(spark, sf)
    objects = pixels.select("sample_id", "cell_no").distinct()
    labels = objects.withColumn("cell_type_id", (F.col("cell_no") % 7 - 1).cast("int"))
    dictionary = spark.createDataFrame([*enumerate(RASTER_TYPES)], "cell_type_id int, cell_type string")
    cells = raster.cells_from_raster(
        pixels.withColumn("channels", F.array(*[F.col(c).cast("double") for c in channels])), labels, dictionary, channels, PrepareSettings(16, 10)
    )
    return cells.withColumns({c: F.round(c, 4 if c == "marker_price" else 6) for c in ("x", "y", *[f"marker_{c}" for c in channels])})


def spots(spark, sf):
    """Pixels with one row per spot, numbered from 1 (0 is outside), and the types of their cells."""
    pixels = V.pixels(spark, sf).groupBy("sample_id", "x", "y").agg(
        (F.max("cell_no") + 1).alias("cell_no"), F.array(*[F.max(c).cast("double") for c in ("price", "discount", "tax")]).alias("channels")
    )
    labels = pixels.select("sample_id", "cell_no").distinct().withColumn("cell_type_id", (F.col("cell_no") % 7 - 1).cast("int"))
    return pixels, labels


def written_images(spark, sf) -> str:
    folder = f"{shared_folder(spark)}/images-{uuid.uuid4().hex}"
    image_folder.write_images(*spots(spark, sf), folder)
    return folder


@query(
    "s6_image_pixels",
    with_views(
        V.PIXELS_SQL,
        "SELECT sample_id, x, y, max(cell_no) + 1 AS cell_no, max(tax) AS tax, max(price) AS price FROM pixels GROUP BY sample_id, x, y",
    ),
)
def image_pixels(spark, sf):
    """An image folder written and read in bands, two of its channels in another order."""
    found = image_folder.read_pixels(spark, written_images(spark, sf), channels="2,0", bandBytes="8192")
    return found.select("sample_id", "x", "y", "cell_no", F.get("channels", 0).alias("tax"), F.get("channels", 1).alias("price"))


@query(
    "s6_image_labels",
    with_views(
        V.PIXELS_SQL,
        """spots AS (SELECT sample_id, x, y, max(cell_no) + 1 AS cell_no FROM pixels GROUP BY ALL)
        SELECT sample_id, cell_no, count(*) AS n_pixels, CAST(cell_no % 7 - 1 AS INTEGER) AS cell_type_id FROM spots GROUP BY 1, 2""",
    ),
)
def image_labels(spark, sf):
    """Cells of an image folder by both of its readers."""
    pixels, labels = raster.read_raster(spark, written_images(spark, sf))
    return pixels.groupBy("sample_id", "cell_no").agg(F.count("*").alias("n_pixels")).join(labels, ["sample_id", "cell_no"])


@query(
    "p7_drop_empty_cells",
    with_views(
        V.PIXELS_SQL, OBJECTS_SQL,
        "SELECT sample_id, cell_no, n_pixels, cell_no % 7 - 1 AS cell_type_id FROM objects WHERE cell_no % 7 - 1 >= 0",
    ),
)
def drop_empty_cells(spark, sf):
    cells = ingest.cells_from_pixels(V.pixels(spark, sf), []).withColumn("cell_type_id", F.col("cell_no") % 7 - 1)
    return ingest.drop_empty(cells).select("sample_id", "cell_no", "n_pixels", "cell_type_id")


def role_sql(role: str, column: str = "cell_type") -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), '{t}')" for t in ROLE_TERMS[role]) + ")"


ROLE_ROWS_SQL = "role_rows AS (" + " UNION ALL ".join(
    f"SELECT region_id, cell_id, '{role}' AS role FROM typed WHERE {role_sql(role)}" for role in ROLE_TERMS
) + ")"


@query("p8_role_rows", with_views(TYPED_SQL, ROLE_ROWS_SQL, "SELECT region_id, cell_id, role FROM role_rows"))
def role_rows(spark, sf):
    return ingest.role_rows(typed_cells(spark, sf))


@query("p9_slugs", "SELECT DISTINCT replace(lower(c_name || ' ' || c_mktsegment), ' ', '_') AS slug FROM customer")
def slugs(spark, sf):
    customer = V.table(spark, sf, "customer")
    return customer.select(C.slug(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("slug")).distinct()


@query(
    "p10_finite_or_default",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_discount = 0 THEN 0.0::DOUBLE ELSE round(l_tax / l_discount, 6) END AS ratio,
       count(*) AS n FROM lineitem GROUP BY ALL""",
)
def finite_or_default(spark, sf):
    line = V.table(spark, sf, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(
        F.col("l_tax") / F.col("l_discount")
    )
    return line.select(
        "l_orderkey", "l_partkey", "l_linenumber", F.round(C.finite_or(ratio), 6).alias("ratio")
    ).groupBy("l_orderkey", "l_partkey", "l_linenumber", "ratio").agg(F.count("*").alias("n"))


@query(
    "p11_marker_rows",
    with_views(
        V.CELLS_SQL,
        """SELECT region_id, cell_id, 'marker_k' AS marker, coalesce(marker_k, 0) AS value FROM cells
           UNION ALL SELECT region_id, cell_id, 'marker_v', coalesce(marker_v, 0) FROM cells""",
    ),
)
def marker_rows(spark, sf):
    return ingest.marker_rows(V.cells(spark, sf))


@query(
    "p12_canonical_labels",
    "SELECT c_custkey, CASE trim(c_mktsegment) WHEN 'BUILDING' THEN 'CLR' WHEN 'MACHINERY' THEN 'DII' ELSE trim(c_mktsegment) END AS label FROM customer",
)
def canonical_labels(spark, sf):
    mapping = C.label_map_from_text(F.lit("BUILDING=CLR,MACHINERY=DII"))
    customer = V.table(spark, sf, "customer")
    text = F.trim("c_mktsegment")
    return customer.select("c_custkey", F.coalesce(F.try_element_at(mapping, text), text).alias("label"))


@query(
    "p13_log_markers",
    with_views(V.CELLS_SQL, "SELECT cell_id, round(ln(1 + greatest(marker_k - 50, 0)), 9) AS k, round(ln(1 + greatest(marker_v, 0)), 9) AS v FROM cells"),
)
def log_markers(spark, sf):
    return V.cells(spark, sf).select(
        "cell_id", F.round(C.log_marker(F.col("marker_k") - 50), 9).alias("k"), F.round(C.log_marker(F.col("marker_v")), 9).alias("v")
    )


@query(
    "p14_type_vocabulary",
    with_views(V.CELLS_SQL, "SELECT cell_type, CAST(row_number() OVER (ORDER BY cell_type) - 1 AS INTEGER) AS type_id FROM (SELECT DISTINCT cell_type FROM cells)"),
)
def type_vocabulary(spark, sf):
    return ingest.vocabulary(V.cells(spark, sf), "cell_type", "type_id")


@query(
    "p15_label_codes",
    with_views(V.REGIONS_SQL, "SELECT region_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS y FROM regions"),
)
def label_codes(spark, sf):
    return ingest.encode(V.regions(spark, sf), "label", "y").select("region_id", "label", "y")


@query(
    "p16_lift_normalization",
    with_views(
        V.CELLS_SQL, V.REGIONS_SQL,
        """s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy
             FROM cells JOIN regions USING (region_id) WHERE CAST(patient_id AS INTEGER) % 4 <> 0)
           SELECT cell_id, round((x - mx) / greatest(CASE WHEN sx > 1e-6 THEN sx ELSE 1 END, 1e-6), 6) + 0.0::DOUBLE AS x,
                  round((y - my) / greatest(CASE WHEN sy > 1e-6 THEN sy ELSE 1 END, 1e-6), 6) + 0.0::DOUBLE AS y FROM cells, s""",
    ),
)
def lift_normalization(spark, sf):
    cells = V.cells(spark, sf)
    train = V.regions(spark, sf).where(F.col("patient_id").cast("int") % 4 != 0).select("region_id")
    stats = ingest.lift_statistics(cells.join(train, "region_id", "left_semi"), ["x", "y"])
    return ingest.lift(cells.select("cell_id", "x", "y"), stats).select("cell_id", r6(F.col("x"), "x"), r6(F.col("y"), "y"))


@query(
    "p17_sigmoid",
    with_views(V.SCORES_SQL, "SELECT row_id, round(1 / (1 + exp(-main_logit)), 9) AS p FROM scores"),
)
def sigmoids(spark, sf):
    return V.scores(spark, sf).select("row_id", F.round(C.sigmoid(F.col("main_logit")), 9).alias("p"))


@query(
    "p18_feature_metadata",
    with_views(
        V.CELLS_SQL, V.REGIONS_SQL,
        """SELECT region_id, 'cell_count' AS name, CAST(count(*) AS DOUBLE) AS value, sample_id, patient_id, label,
           'unassigned' AS split, 'F0' AS feature_family FROM cells JOIN regions USING (region_id) GROUP BY ALL""",
    ),
)
def feature_metadata(spark, sf):
    counts = composition.melt(composition.extent(V.cells(spark, sf)), ["cell_count"])
    return ingest.attach_metadata(counts, V.regions(spark, sf), "F0")


@query("j1_cell_labels", with_views(V.CELLS_SQL, V.REGIONS_SQL, "SELECT cell_id, region_id, label FROM cells LEFT JOIN regions USING (region_id)"))
def cell_labels(spark, sf):
    return ingest.join_labels(V.cells(spark, sf).select("cell_id", "region_id"), V.regions(spark, sf))


PROXY_SQL = f"""proxy AS (SELECT region_id, min(patient_no) AS patient_no, CASE WHEN count(*) FILTER (cell_type IN ({names(IMMUNE_TYPES)}))
  >= count(*) FILTER (cell_type IN ({names(TUMOR_STROMA_TYPES)})) THEN 'immune_rich' ELSE 'tumor_stroma_rich' END AS proxy_label
  FROM typed GROUP BY region_id)"""


@query("a4_proxy_labels", with_views(TYPED_SQL, PROXY_SQL, "SELECT region_id, proxy_label FROM proxy"))
def proxy_labels(spark, sf):
    return ingest.proxy_labels(typed_cells(spark, sf))


@query(
    "j2_clinical_labels",
    with_views(
        TYPED_SQL, PROXY_SQL,
        f"""notes AS (SELECT {patient_sql("CASE WHEN c_custkey % 2 = 0 THEN 'p' ELSE '' END || CAST(c_nationkey AS VARCHAR)")} AS patient_id,
             c_mktsegment AS label, c_custkey FROM customer),
           last_note AS (SELECT patient_id, arg_max(label, c_custkey) AS label FROM notes GROUP BY 1),
           named AS (SELECT region_id, 'P' || CASE WHEN patient_no < 10 THEN '0' ELSE '' END || CAST(patient_no AS VARCHAR) AS patient_id, proxy_label FROM proxy)
           SELECT region_id, patient_id, coalesce(label, proxy_label) AS label,
                  CASE WHEN label IS NULL THEN 'proxy_patch_tme' ELSE 'clinical_patient_label' END AS label_mode
           FROM named LEFT JOIN last_note USING (patient_id)""",
    ),
)
def clinical_labels(spark, sf):
    customer = V.table(spark, sf, "customer")
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, "p").otherwise(""), F.col("c_nationkey").cast("string"))
    notes = customer.select(raw.alias("patient_id"), F.col("c_mktsegment").alias("label"), "c_custkey")
    clinical = ingest.patient_labels(notes, F.col("c_custkey"))
    typed = typed_cells(spark, sf)
    proxies = typed.groupBy("region_id").agg(
        F.min("patient_no").alias("patient_no"), C.proxy_label(F.col("cell_type")).alias("proxy_label")
    )
    named = proxies.select("region_id", C.patient_id(F.col("patient_no")).alias("patient_id"), "proxy_label")
    return ingest.label_regions(named, clinical).select("region_id", "patient_id", "label", "label_mode")


@query("j10_region_labels", with_views(V.REGIONS_SQL, "SELECT DISTINCT region_id, label FROM regions"))
def region_labels(spark, sf):
    return ingest.region_labels(V.regions(spark, sf))


@query(
    "a2_region_table",
    with_views(
        V.CELLS_SQL, V.REGIONS_SQL,
        """SELECT region_id, arg_min(sample_id, cell_id) AS sample_id, arg_min(patient_id, cell_id) AS patient_id,
           arg_min(label, cell_id) AS label, count(*) AS n_cells FROM cells JOIN regions USING (region_id) GROUP BY 1""",
    ),
)
def region_table(spark, sf):
    return ingest.region_table(V.cells(spark, sf).join(V.regions(spark, sf), "region_id"))


@query(
    "a3_large_regions",
    with_views(V.CELLS_SQL, "SELECT cell_id, region_id FROM cells WHERE region_id IN (SELECT region_id FROM cells GROUP BY 1 HAVING count(*) >= 66)"),
)
def large_regions(spark, sf):
    return ingest.keep_large_regions(V.cells(spark, sf).select("cell_id", "region_id"), 66)


@query(
    "a17_class_weights",
    with_views(V.SCORES_SQL, "SELECT y, count(*) AS n, round(sum(count(*)) OVER () / greatest(count(*), 1), 9) AS weight FROM scores GROUP BY y"),
)
def class_weights(spark, sf):
    weights = ingest.inverse_frequency_weights(V.scores(spark, sf))
    return weights.select("y", "n", F.round("weight", 9).alias("weight"))
