"""Scalar column expressions: identifiers, roles, compartments, calibration."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cytoplane.settings import IMMUNE_TYPES, TUMOR_STROMA_TYPES, VASCULAR_TYPES


def patient_id(value: Column) -> Column:
    """Trim, drop the ``.0`` of a numeric id and pad ``7``, ``p7`` or ``P07`` to ``P07``."""
    text = F.regexp_replace(F.trim(value.cast("string")), r"^(\d+)\.0$", "$1")
    digits = F.regexp_replace(F.regexp_extract(text, r"^[Pp]?(\d+)$", 1), r"^0+(?=\d)", "")
    padded = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    return F.when(F.length(digits) > 0, F.concat(F.lit("P"), padded)).otherwise(text)


def patient_of_sample(sample_id: Column) -> Column:
    return patient_id(F.substring_index(sample_id, "_", 1))


def compartment(cell_type: Column) -> Column:
    return (
        F.when(cell_type == "Tumor", "tumor")
        .when(cell_type == "Stroma", "stroma")
        .when(cell_type.isin(*IMMUNE_TYPES), "immune")
        .when(cell_type.isin(*VASCULAR_TYPES), "vascular")
        .when(cell_type == "Neuron", "neural")
        .otherwise("other")
    )


def proxy_label(cell_type: Column) -> Column:
    """Aggregate: a region with at least as many immune as tumor and stroma cells is immune-rich."""
    immune = F.count_if(cell_type.isin(*IMMUNE_TYPES))
    solid = F.count_if(cell_type.isin(*TUMOR_STROMA_TYPES))
    return F.when(immune >= solid, "immune_rich").otherwise("tumor_stroma_rich")


def patch_region(sample_id: Column, x: Column, y: Column, size: int = 256) -> Column:
    """Region key of the absolute pixel grid."""
    step = F.lit(float(size))
    return F.concat_ws(
        "_", sample_id, F.lit("patch"), F.floor(x / step).cast("string"), F.floor(y / step).cast("string")
    )


def has_role(cell_type: Column, terms: Iterable[str]) -> Column:
    lowered = F.lower(F.coalesce(cell_type, F.lit("")))
    return reduce(lambda a, b: a | b, [lowered.contains(term) for term in terms])


def slug(value: Column) -> Column:
    return F.replace(F.lower(value.cast("string")), F.lit(" "), F.lit("_"))


def finite_or(value: Column, default: float = 0.0) -> Column:
    number = value.cast("double")
    bad = number.isNull() | F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(bad, F.lit(float(default))).otherwise(number)


def canonical_label(label: Column, mapping: Mapping[str, str] | None = None) -> Column:
    text = F.trim(label.cast("string"))
    if not mapping:
        return text
    table = F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])
    return F.coalesce(F.element_at(table, text), text)


def label_map_from_text(text: Column) -> Column:
    """``raw=canonical,raw=canonical`` as a map."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def log_marker(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def platt(logit: Column, slope: Column, intercept: Column) -> Column:
    return sigmoid(slope * logit + intercept)


def temperature_probability(
    logit: Column,
    *,
    temperature: float = 0.5,
    mode: str = "confidence_temperature",
    scale: float = 0.75,
    power: float = 2.0,
) -> Column:
    """Fixed temperature, or one that grows with confidence: T * (1 + scale * |2p - 1| ** power)."""
    plain = sigmoid(logit / F.lit(max(temperature, 1e-6)))
    if mode == "temperature":
        return plain
    if mode != "confidence_temperature":
        raise ValueError(f"unknown calibration mode {mode!r}")
    confidence = F.abs(plain - 0.5) * 2.0
    heat = F.greatest(F.lit(temperature) * (1.0 + F.lit(scale) * F.pow(confidence, F.lit(power))), F.lit(1e-6))
    return sigmoid(logit / heat)


def logit_margin(raw: Column) -> Column:
    """Positive minus negative logit of a two-class score array."""
    return F.get(raw, 1) - F.get(raw, 0)


def checkpoint_score(auroc: Column, balanced: Column, macro_f1: Column, weight: float = 0.4) -> Column:
    rest = 1.0 - weight
    return auroc * weight + balanced * (rest * 0.55) + macro_f1 * (rest * 0.25)


def entropy_term(share: Column) -> Column:
    return -share * F.log(share + 1e-12)
