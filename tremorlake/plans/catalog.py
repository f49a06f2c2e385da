"""The query catalog: importing the query modules fills the registry."""

from __future__ import annotations

from tremorlake.plans import (  # noqa: F401
    q_evaluate, q_features, q_model, q_quality, q_sampling, q_stream, q_tables, q_waveform)
from tremorlake.plans.registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
