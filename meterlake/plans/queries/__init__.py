"""All registered queries with their SQL counterparts."""

from meterlake.plans.queries import edges, fitted, models, sequences, summaries, tables  # noqa: F401  (registration)
from meterlake.plans.queries.catalog import QUERIES, SQL  # noqa: F401
