"""Query catalogue: importing this package registers every query."""

from paperloom.plans import edits_exports, live, model_work, records, search_risk, text_stats  # noqa: F401
from paperloom.plans.registry import ORACLES, QUERIES  # noqa: F401
