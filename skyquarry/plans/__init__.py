"""All registered queries."""

from skyquarry.plans import catalog, exchange, extras, jobs, lifecycle, raster, scalars, terrain  # noqa: F401
from skyquarry.plans.registry import SQL, runnable  # noqa: F401
