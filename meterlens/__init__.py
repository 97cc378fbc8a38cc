"""Analytics over power-meter and temperature telemetry, as PySpark DataFrame operators."""

from meterlens.functions.buckets import bucket
from meterlens.operators.compare import compare, compare_latest, compare_metric
from meterlens.operators.cost import (
    energy_compare,
    energy_compare_total,
    energy_cost,
    energy_total,
)
from meterlens.operators.decode import decode_device_list, decode_pme5
from meterlens.operators.history import history
from meterlens.operators.latest import latest_per_device
from meterlens.operators.series import series
from meterlens.operators.summary import dashboard, series_and_summary, summary
from meterlens.operators.totals import phases, total
from meterlens.plans.modes import Mode, in_window, resolve_mode, resolve_period
from meterlens.plans.rollup import hourly_rollup
from meterlens.streaming.ingest import ingest, quarantine
from meterlens.streaming.sample import sample_latest
from meterlens.streaming.spacing import sample_spacing

__all__ = [
    "Mode",
    "bucket",
    "compare",
    "compare_latest",
    "compare_metric",
    "dashboard",
    "decode_device_list",
    "decode_pme5",
    "energy_compare",
    "energy_compare_total",
    "energy_cost",
    "energy_total",
    "history",
    "hourly_rollup",
    "in_window",
    "ingest",
    "latest_per_device",
    "phases",
    "quarantine",
    "resolve_mode",
    "resolve_period",
    "sample_latest",
    "sample_spacing",
    "series",
    "series_and_summary",
    "summary",
    "total",
]
