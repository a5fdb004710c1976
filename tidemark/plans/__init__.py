"""All registered queries; importing this package fills the catalogue."""

from . import (  # noqa: F401
    aggregate_queries,
    basics,
    fitted_queries,
    insight_queries,
    model_queries,
    planning_queries,
    statistic_queries,
    stream_queries,
    window_queries,
)
from .catalog import CATALOG

__all__ = ["CATALOG"]
