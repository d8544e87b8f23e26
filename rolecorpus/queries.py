"""All registered queries of the library and their SQL."""

from .catalog import corpus, enrich, flows, sources, stores  # noqa: F401
from .catalog.base import ORACLES, QUERIES  # noqa: F401
