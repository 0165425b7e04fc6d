"""Six shifted copies of one small region: a unit square, three cells in line, two at one spot and a loner.

Coordinates are small integers, so shifts are exact and distances are known by hand; the median
neighbour distance is 4, so that scaling by it is exact too.
"""

SHAPES = {
    "tumor": ((0, 0), (1, 0), (1, 1), (0, 1)),
    "cd8_t": ((4, 0), (5, 0), (6, 0)),
    "vessel": ((0, 6), (0, 6)),
    "macrophage": ((10, 10),),
}
REGIONS, CELLS_IN_REGION = 6, 10
SCHEMA = (
    "cell_id string, sample_id string, patient_id string, region_id string, x double, y double, cell_type string, "
    "compartment string, marker_cd8 double, marker_tumor double, label string"
)


def label_of(region):
    return "high" if region % 3 == 2 else "low"


def cells(spark):
    shape = spark.createDataFrame([(kind, k, x, y) for kind, spots in SHAPES.items() for k, (x, y) in enumerate(spots)], "kind string, k int, px int, py int")
    names = spark.createDataFrame([(r, label_of(r)) for r in range(REGIONS)], "r int, label string")
    is_a = lambda kind: f"if(kind = '{kind}', 2.0D, 0.5D)"
    return shape.join(names).selectExpr(
        "concat('region', r, '-', kind, k) as cell_id", "concat('slide', r) as sample_id", "concat('patient', r % 3) as patient_id",
        "concat('region', r) as region_id", "cast(px + 32 * r as double) as x", "cast(py - 16 * r as double) as y", "kind as cell_type",
        "if(kind = 'tumor', 'nest', 'stroma') as compartment", f"{is_a('cd8_t')} as marker_cd8", f"{is_a('tumor')} as marker_tumor", "label",
    ).to(spark.createDataFrame([], SCHEMA).schema)
