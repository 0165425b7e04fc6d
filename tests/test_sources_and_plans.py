import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoplane.operators import scoring
from cytoplane.operators.elastic_net import vector_of
from cytoplane.plans import features as P
from cytoplane.plans import report
from cytoplane.plans.examples import region_examples
from cytoplane.plans.study import Head, cross_validate, fold_scores
from cytoplane.plans import study
from cytoplane.settings import BOUNDS, PrepareSettings, StudySettings
from cytoplane.sources import image_folder, raster, tables
from tests import fixture


def test_cell_study_round_trip_and_errors(spark, tmp_path):
    cells = fixture.cells(spark)
    cells.drop("label").write.parquet(f"{tmp_path}/cells.parquet")
    cells.select("region_id", "label").distinct().write.option("header", True).csv(f"{tmp_path}/regions.csv")
    with pytest.raises(ValueError, match="no 'label' column"):
        tables.load_cell_study(spark, f"{tmp_path}/cells.parquet")
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, "cells.xyz")
    study = tables.load_cell_study(spark, f"{tmp_path}/cells.parquet", f"{tmp_path}/regions.csv", "demo")
    tables.save_study(study, f"{tmp_path}/study")
    back = tables.load_study(spark, f"{tmp_path}/study")
    assert back.cells.count() == 60 and back.meta.first().dataset_name == "demo"
    assert {(r.region_id, r.n_cells, r.label) for r in back.regions.collect()} == {
        (f"region{i}", fixture.CELLS_IN_REGION, fixture.label_of(i)) for i in range(fixture.REGIONS)
    }
    assert "n_cells" not in back.tasks.columns


def test_translated_regions_have_equal_features(spark, tmp_path):
    cells = fixture.cells(spark)
    regions = cells.groupBy("region_id").agg(*[F.first(c).alias(c) for c in ("sample_id", "patient_id", "label")])
    table = P.feature_table(cells, regions)
    spread = table.groupBy("feature_family", "name").agg(
        F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("d"), F.first("value").alias("v")
    ).collect()
    assert all(r.n == fixture.REGIONS and r.d == pytest.approx(0, abs=1e-6) for r in spread)
    value = {r.name: r.v for r in spread}
    assert value["cell_count"] == 10 and value["prop_celltype_tumor"] == 0.4
    assert value["prop_compartment_stroma"] == 0.6
    assert value["tumor_to_cd8_min"] == 0.75 and value["treg_h0_count"] == 0
    assert value["union_tumor_cd8_h0_count"] == 6 and value["tumor_h1_count"] == 1
    tables.save_features(table, f"{tmp_path}/features")
    long = tables.load_feature_csv(spark, f"{tmp_path}/features/feature_table_csv")
    assert long.count() == table.count()
    wide, names = P.engineered_features(tables.load_features(spark, f"{tmp_path}/features"))
    assert wide.count() == fixture.REGIONS and set(names) == set(value)
    more = table
    for family in ("A1", "B2", "G7"):
        more = more.unionByName(table.where("feature_family = 'F0'").withColumn("feature_family", F.lit(family)))
    assert sorted(P.engineered_features(more)[1]) == sorted(names)


def test_region_examples(spark):
    cells = fixture.cells(spark)
    regions = cells.groupBy("region_id").agg(*[F.first(c).alias(c) for c in ("patient_id", "label")])
    example = region_examples(cells, regions, sorted(fixture.SHAPES))
    assert example.cells.count() == 60 and {"near_tumor", "label", "marker_cd8"} <= set(example.cells.columns)
    assert {r["scale"] for r in example.edges.select("scale").distinct().collect()} == {"base", "expanded", "global"}
    shares = example.cells.select(sum(F.col(f"near_{t}") for t in sorted(fixture.SHAPES)).alias("s")).agg(F.min("s"), F.max("s")).first()
    assert shares[0] == pytest.approx(1) and shares[1] == pytest.approx(1)


def test_raster_study(spark, tmp_path):
    for folder in ("cells", "cells2labels", "data/antibodies"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "channels_codex_CRC_celltune.txt").write_text("CD8\n\n DAPI \n")
    (tmp_path / "mapping_id_to_cell_type_name.txt").write_text("{0: 'Tumor', 1: 'CD8T'}")
    mask = np.zeros((6, 8), dtype=int)
    mask[0:2, 0:2], mask[3:5, 5:8], mask[5, 0], mask[2, 7] = 1, 2, 3, 4
    image = np.stack([np.arange(48).reshape(6, 8), np.ones((6, 8))], axis=-1)
    for stem, complete in (("7_A", True), ("8_B", False)):
        np.savez(tmp_path / "cells" / f"{stem}.npz", data=mask)
        np.savez(tmp_path / "cells2labels" / f"{stem}.npz", data=np.array([-1, 0, 1, -1, 9]))
        if complete:
            np.savez(tmp_path / "data/antibodies" / f"{stem}.npz", data=image)
    study = raster.load_raster_study(spark, str(tmp_path), settings=PrepareSettings(patch_size_px=4, min_cells_per_region=1))
    got = {r.cell_id: r for r in study.cells.collect()}
    assert set(got) == {"7_A_cell_1", "7_A_cell_2", "7_A_cell_4"}
    one, two = got["7_A_cell_1"], got["7_A_cell_2"]
    assert (one.x, one.y, one.marker_CD8, one.marker_DAPI) == (0.5, 0.5, 4.5, 1.0)
    assert (two.x, two.y, two.cell_type, two.compartment) == (6.0, 3.5, "CD8T", "immune")
    assert got["7_A_cell_4"].cell_type == "Unknown" and one.patient_id == "P07"
    assert (one.region_id, two.region_id) == ("7_A_patch_0_0", "7_A_patch_1_0")
    labels = {r.region_id: (r.label, r.label_mode, r.n_cells) for r in study.regions.collect()}
    assert labels == {
        "7_A_patch_0_0": ("tumor_stroma_rich", "proxy_patch_tme", 1), "7_A_patch_1_0": ("immune_rich", "proxy_patch_tme", 2)
    }
    clinical = spark.createDataFrame([("P07", "DII")], "patient_id string, label string")
    named = raster.load_raster_study(spark, str(tmp_path), clinical, settings=PrepareSettings(4, 1))
    assert {(r.label, r.label_mode) for r in named.regions.collect()} == {("DII", "clinical_patient_label")}


def test_images_are_read_in_bands(spark, tmp_path):
    rng = np.random.default_rng(3)
    for folder in ("cells", "cells2labels", "data/antibodies"):
        (tmp_path / folder).mkdir(parents=True)
    mask = rng.integers(0, 4, (37, 11))
    mask[5:9] = 0
    image = rng.random((37, 11, 3)).astype(np.float32)
    savers = {"plain": (np.savez, "C"), "packed": (np.savez_compressed, "C"), "turned": (np.savez, "F"), "lone": (np.savez, "C")}
    for stem, (save, order) in savers.items():
        save(tmp_path / "cells" / f"{stem}.npz", data=np.asarray(mask, order=order))
        save(tmp_path / "cells2labels" / f"{stem}.npz", data=np.array([-1, 0, 1, 2]))
        if stem != "lone":
            save(tmp_path / "data/antibodies" / f"{stem}.npz", data=np.asarray(image, order=order))
    wanted = sorted((float(x), float(y), int(mask[y, x]), [float(v) for v in image[y, x]]) for y, x in zip(*np.nonzero(mask)))
    for size in (700, 1 << 20):
        found = image_folder.read_pixels(spark, str(tmp_path), bandBytes=str(size))
        assert found.rdd.getNumPartitions() == 3 if size > 700 else found.rdd.getNumPartitions() > 12
        for stem in ("plain", "packed", "turned"):
            rows = found.where(F.col("sample_id") == stem).collect()
            assert sorted((r.x, r.y, r.cell_no, r.channels) for r in rows) == wanted
        assert found.select("sample_id").distinct().count() == 3
    part = image_folder.read_pixels(spark, f"file:{tmp_path}", samples="packed", channels="2,0")
    assert sorted((r.x, r.y, r.channels) for r in part.collect()) == [(x, y, [c[2], c[0]]) for x, y, _, c in wanted]
    empty = tmp_path / "empty"
    nothing = part.limit(0)
    image_folder.write_images(nothing, nothing.withColumn("cell_type_id", F.lit(0)), str(empty))
    assert image_folder.read_pixels(spark, str(empty)).isEmpty()


def test_images_written_again_are_the_same(spark, tmp_path):
    pixels = spark.createDataFrame(
        [("a", 0.0, 2.0, 3, [1.0, 2.0]), ("a", 4.0, 0.0, 1, [0.5, 0.0]), ("b", 1.0, 1.0, 2, [7.0, 8.0])],
        "sample_id string, x double, y double, cell_no long, channels array<double>",
    )
    labels = spark.createDataFrame([("a", 3, 5), ("b", 2, 0), ("c", 1, 1)], "sample_id string, cell_no long, cell_type_id int")
    for _ in range(2):
        image_folder.write_images(pixels, labels, str(tmp_path))
        assert sorted(p.name for p in (tmp_path / "cells").iterdir()) == ["a.npz", "b.npz", "c.npz"]
        found, types = raster.read_raster(spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pixels.collect()))
        assert types.where("cell_type_id >= 0").count() == 3 and types.where("sample_id = 'a'").count() == 4


def test_labels_of_sparse_cell_numbers_follow_the_cells(spark, tmp_path):
    far = 50_000_000
    pixels = spark.createDataFrame(
        [("a", 0.0, 0.0, 3, [1.0]), ("a", 1.0, 0.0, far, [2.0])], "sample_id string, x double, y double, cell_no long, channels array<double>"
    )
    labels = spark.createDataFrame([("a", 3, 5), ("a", far, 6)], "sample_id string, cell_no long, cell_type_id int")
    image_folder.write_images(pixels, labels, str(tmp_path))
    assert (tmp_path / "cells2labels/a.npz").stat().st_size < 2000
    found, types = raster.read_raster(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, pixels.collect()))
    assert sorted(map(tuple, types.collect())) == [("a", 3, 5), ("a", far, 6)]


def test_many_small_images_share_tasks(spark, tmp_path):
    for folder in ("cells", "cells2labels", "data/antibodies"):
        (tmp_path / folder).mkdir(parents=True)
    for k in range(700):
        np.savez(tmp_path / "cells" / f"s{k}.npz", data=np.array([[k + 1], [0], [7]]))
        np.savez(tmp_path / "cells2labels" / f"s{k}.npz", data=np.array([0]))
        np.savez(tmp_path / "data/antibodies" / f"s{k}.npz", data=np.full((3, 1, 1), k / 2))
    for size in (1 << 20, 300):
        found = image_folder.read_pixels(spark, str(tmp_path), bandBytes=str(size))
        assert found.rdd.getNumPartitions() <= image_folder.SINGLE_BANDS
        rows = sorted((int(r.sample_id[1:]), r.y, r.cell_no, r.channels[0]) for r in found.collect())
        assert rows == [(k, y, n, k / 2) for k in range(700) for y, n in ((0.0, k + 1), (2.0, 7))]


def test_guard_is_not_turned_by_a_tied_row(spark):
    rows = [(0, "val", 1, 0.9, 0.1), (0, "val", 1, 0.8, 0.5), (0, "val", 0, 0.5, 0.5), (0, "val", 0, 0.2, 0.9), (0, "test", 1, 0.7, 0.3)]
    frame = spark.createDataFrame(rows, "fold int, role string, y int, main double, mix double")
    guarded = study._safe(frame, F.col("role") == "val", ["fold"], "main", "mix", 0.005, "p", BOUNDS)
    assert all(r.p == r.main for r in guarded.collect())


def test_study_and_report(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [
        (f"r{i}", f"p{i // 4}", "AB"[(i // 4) % 2], float((i // 4) % 2 + rng.normal(0, 0.4)), float(rng.normal()))
        for i in range(64)
    ]
    frame = spark.createDataFrame(rows, "region_id string, patient_id string, label string, good double, noise double")
    heads = {"main": Head(frame, ["good", "noise"]), "graph": Head(frame, ["noise"])}
    result = cross_validate(frame.select("region_id", "patient_id", "label"), heads, "demo", StudySettings(n_splits=2), n_boot=50)
    means = {r.metric: r["mean"] for r in result.summary.collect()}
    assert means["auroc"] > 0.8 and 0 <= means["brier_score"] <= 1 and 0 <= means["blend_alpha"] <= 1
    tables.save_results(result.fold_metrics, result.summary, f"{tmp_path}/run")
    metrics, summary = tables.load_results(spark, f"{tmp_path}/run")
    assert metrics.count() == result.fold_metrics.count()
    scores = spark.createDataFrame([("r1", report.CASE_SCORE, 1.0), ("r2", report.CASE_SCORE, 3.0)], "region_id string, name string, value double")
    shown = report.report_tables(summary, scores, summary)
    assert shown["best_run"].first().run == "demo" and shown["auroc_delta"].first().delta == 0.0
    assert [(r.case, r.region_id) for r in shown["cases"].collect()] == [("lowest", "r1"), ("highest", "r2")]
    assert shown["runs"].first().feature_stability is None
    assert scoring.best_run(summary).count() == 1


def test_feature_vectors_are_the_wide_features(spark, monkeypatch):
    value = lambda r, k: [None, float("nan"), float("inf"), 0.5 * r + k][min((r * 5 + k) % 7, 3)]
    rows = [(f"r{r}", family, f"n{k}", value(r, k)) for r in range(9) for family, most in (("F0", 4), ("F1", 6), ("G7", 3)) for k in range(most) if (r + k) % 5 and (r, family) not in ((3, "F0"), (4, "F1"))]
    table = spark.createDataFrame(rows, "region_id string, feature_family string, name string, value double")
    monkeypatch.setattr(P, "VECTOR_ENTRIES", 25)
    for part in (table, table.where("feature_family = 'F0'"), table.where("feature_family = 'F1'")):
        wide, names = P.engineered_features(part)
        vectors, same = P.feature_vectors(part)
        want = {r.region_id: list(r.x) for r in wide.select("region_id", vector_of(names).alias("x")).collect()}
        got = vectors.collect()
        assert same == names and len(got) == len(want) and {r.region_id: list(r.x) for r in got} == want
    with pytest.raises(ValueError, match="neither"):
        P.feature_vectors(table.where("feature_family = 'G7'"))


def test_heads_of_a_thousand_features_are_no_wide_plan(spark):
    rows = [(r, f"p{r % 8}", "AB"[r % 2], [float((r * 7 + k) % 11) + 3.0 * (r % 2) * (k == 5) for k in range(40)]) for r in range(80)]
    frame = spark.createDataFrame(rows, "region_id int, patient_id string, label string, x array<double>")
    names = [f"n{k}" for k in range(40)]
    wide = frame.select("region_id", *[F.get("x", k).alias(n) for k, n in enumerate(names)])
    folds = StudySettings(n_splits=2)
    regions = frame.select("region_id", "patient_id", "label")
    a, b = (fold_scores(regions, {"main": Head(t, names)}, folds)[0] for t in (frame.select("region_id", "x"), wide))
    told = lambda s: sorted((r.repeat, r.fold, r.role, r.region_id, round(r.logit, 9)) for r in s.collect())
    assert told(a) == told(b) and told(a)


def test_feature_vectors_of_known_names_need_no_pass_over_the_table(spark):
    rows = [(r, family, f"n{k}", r + k / 8) for r in range(4) for family in ("F0", "F1") for k in range(3)]
    table = spark.createDataFrame(rows, "region_id long, feature_family string, name string, value double")
    vectors, names = P.feature_vectors(table)
    known, same = P.feature_vectors(table, {"F0": ["n0", "n1", "n2"], "F1": ["n0", "n1", "n2"]})
    assert P.names_by_family(table) == {"F0": ["n0", "n1", "n2"], "F1": ["n0", "n1", "n2"]}
    assert same == names and sorted(map(str, known.collect())) == sorted(map(str, vectors.collect()))
