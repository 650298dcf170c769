"""playerlytics: player-behaviour analytics on PySpark.

Enrich raw mobile-game events into hourly, daily and monthly per-player rollups, then
segment players with k-means, compute lifetime value and N-day cohort retention. All
functions take and return DataFrames on the caller's SparkSession.
"""

__version__ = "0.1.0"

from .functions.time import MonthRange  # noqa: E402
from .plans.jobs import run_elbow, run_enrich, run_ltv, run_retention, run_segmentation  # noqa: E402
from .sources.events import read_events  # noqa: E402
from .streaming.rerun import enrich_on_arrival  # noqa: E402

__all__ = ["MonthRange", "read_events", "run_enrich", "run_elbow", "run_segmentation", "run_ltv",
           "run_retention", "enrich_on_arrival"]
