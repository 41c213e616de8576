"""All registered queries (importing a query module registers its queries)."""

from fieldtide.plans import (  # noqa: F401
    assess_queries, feature_queries, job_queries, raster_queries, scene_queries, series_queries,
)
from fieldtide.plans.registry import ORACLES, QUERIES  # noqa: F401
