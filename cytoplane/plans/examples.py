"""Region examples: scaled cells with structural vectors and labels, and their graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplane.operators import region_graphs as R
from cytoplane.operators.ingest import marker_columns
from cytoplane.session import cut_lineage, measured
from cytoplane.settings import BOUNDS, RegionGraphSettings, SizeBounds


@dataclass
class RegionExamples:
    """``cells``: one row per kept cell; ``edges``: three-scale graphs; ``features``: one row per region."""

    cells: DataFrame
    edges: DataFrame
    features: DataFrame | None


def region_examples(
    cells: DataFrame,
    regions: DataFrame,
    types: list[str],
    features: DataFrame | None = None,
    settings: RegionGraphSettings = RegionGraphSettings(),
    bounds: SizeBounds = BOUNDS,
) -> RegionExamples:
    """Scale, thin regions above ``max_cells`` where that is set, rescale, build the graphs and attach label, patient, features."""
    base = cells.drop("sample_id", "patient_id", "label")
    bounds = measured(cells, bounds)
    scaled = R.scale_coordinates(base, settings.knn_k, bounds)
    if settings.max_cells is not None and bounds.largest_region > settings.max_cells:
        kept = R.subsample(scaled, settings.max_cells, bounds).drop("scale", "mean_nn")
        scaled = R.scale_coordinates(kept, settings.knn_k, bounds)
    scaled = cut_lineage(scaled)
    edges = R.multiscale_graphs(scaled, settings, bounds)
    base_edges = edges.where(F.col("scale") == "base")
    structure = R.structural_vectors(scaled, base_edges, types)
    markers = [m for m in marker_columns(cells) if m in scaled.columns]
    meta = regions.select("region_id", "patient_id", "label")
    rows = structure.join(scaled.select("region_id", "cell_id", "cell_type", *markers), ["region_id", "cell_id"]).join(
        meta, "region_id"
    )
    return RegionExamples(rows, edges, features)
