"""Importing this module registers every query."""

from workload import q_composition, q_graphs, q_ingest, q_plans, q_scoring, q_topology  # noqa: F401
