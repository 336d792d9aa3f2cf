"""All registered queries."""

from laurel.catalog import authors, factors, payloads, scalars, search, streams  # noqa: F401
from laurel.catalog.registry import ENTRIES  # noqa: F401
