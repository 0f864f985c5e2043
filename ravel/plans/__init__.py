"""Query registry: every operator as a (spark, sf_dir) -> DataFrame callable,
with the equivalent DuckDB SQL where one exists."""

from .registry import QUERIES, ORACLE, register  # noqa: F401


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (q_reports, q_quality, q_training, q_reviews,  # noqa: F401
                   q_eval, q_prompts, q_templates, q_alerts, q_ingest, q_streaming, q_extras)
