"""Parameters, fixed vocabularies and size bounds."""

from __future__ import annotations

from dataclasses import dataclass, field

# Substrings that give a cell type its role.
ROLE_TERMS = {
    "tumor": ("tumor", "epithelial"),
    "cd8": ("cd8",),
    "treg": ("treg", "regulatory t"),
    "macrophage": ("macrophage", "mono"),
    "vessel": ("vessel", "endothelial"),
    "immune": ("cd4", "cd8", "treg", "t cell", "b cell", "nk", "macrophage", "mono", "immune"),
}

# Exact cell-type names behind compartments and proxy labels.
IMMUNE_TYPES = ("Bcell", "CD3T", "CD4T", "CD8T", "DC", "Macrophage", "Neutrophil", "Plasma", "Treg")
VASCULAR_TYPES = ("Endothelial", "Lymphatic")
TUMOR_STROMA_TYPES = ("Tumor", "Stroma")

# Point sets whose persistence is summarised: single roles, then tumor joined with each other role.
SUBSET_ROLES = {
    "tumor": ("tumor",),
    "cd8": ("cd8",),
    "treg": ("treg",),
    "macrophage": ("macrophage",),
    "vessel": ("vessel",),
    "union_tumor_cd8": ("tumor", "cd8"),
    "union_tumor_treg": ("tumor", "treg"),
    "union_tumor_macrophage": ("tumor", "macrophage"),
    "union_tumor_vessel": ("tumor", "vessel"),
}

REQUIRED_CELL_COLUMNS = ("cell_id", "sample_id", "patient_id", "region_id", "x", "y", "cell_type")
NON_MARKER_COLUMNS = REQUIRED_CELL_COLUMNS + ("compartment", "label")


@dataclass(frozen=True)
class PrepareSettings:
    patch_size_px: int = 256
    min_cells_per_region: int = 40


@dataclass(frozen=True)
class FeatureSettings:
    knn_k: int = 10
    patch_size: float = 12.0
    min_patch_cells: int = 6
    top_k_lifetimes: int = 3
    grid_size: int = 32
    role_terms: dict = field(default_factory=lambda: dict(ROLE_TERMS))


@dataclass(frozen=True)
class RegionGraphSettings:
    knn_k: int = 6
    mode: str = "adaptive_knn"
    max_cells: int | None = None
    adaptive_factor: float = 1.5
    global_knn_multiplier: int = 4
    global_distance_multiplier: float = 2.5
    global_max_neighbors: int = 24
    cell_drop_rate: float = 0.15


@dataclass(frozen=True)
class StudySettings:
    n_splits: int = 4
    n_repeats: int = 1
    seed: int = 42
    calibration: str = "platt"
    temperature: float = 0.5
    confidence_scale: float = 0.75
    confidence_power: float = 2.0
    head_min_auroc: float = 0.55
    head_max_auroc_gap: float = 0.20
    blend_tolerance: float = 0.005
    checkpoint_auroc_weight: float = 0.4
    threshold_points: int = 61
    alpha_points: int = 21
    threshold_from: str = "val"


@dataclass(frozen=True)
class SizeBounds:
    """Largest group an operator may hand to one task; beyond it the split plan is used."""

    tile_cells: int = 2048
    halo_rows: int = 65536
    percentile_rows: int = 1_000_000
    triangulation_cells: int = 100_000
    tree_points: int = 100_000
    diagram_points: int = 4096
    shared_points: int = 512  # points of a subset that shares a diagram task with others of its scope
    largest_region: int | None = None  # cells in the biggest region, once measured
    largest_scores: int | None = None  # rows in the biggest score group, once measured


BOUNDS = SizeBounds()
