"""All registered queries."""

from rhopool.plans import catalog_ensemble, catalog_files, catalog_pairs, catalog_tables, catalog_warehouse  # noqa: F401
from rhopool.plans.registry import ORACLES, QUERIES  # noqa: F401
