"""Imports every query module so that all queries are registered."""

from strata.plans import survey_queries  # noqa: F401
from strata.plans import table_queries  # noqa: F401
from strata.plans import cluster_queries  # noqa: F401
from strata.plans import model_queries  # noqa: F401
from strata.plans import codebook_queries  # noqa: F401
from strata.plans import intake_queries  # noqa: F401
from strata.plans import report  # noqa: F401
