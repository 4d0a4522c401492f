"""The labelled panel as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from riskpanel import constants as K
from riskpanel.operators.labels import attach_labels
from riskpanel.operators.panel import build_panel


def labelled_panel(
    entities: DataFrame,
    start: str,
    end: str,
    incidents: DataFrame,
    activity: DataFrame,
    visits: DataFrame,
    visit_index: DataFrame | None = None,
    horizons: Sequence[int] = K.LABEL_HORIZONS,
) -> DataFrame:
    """Features and labels: labels reuse the distribution by entity of the feature frames."""
    panel = build_panel(entities, start, end, incidents, activity, visits, visit_index)
    return attach_labels(panel, horizons)
