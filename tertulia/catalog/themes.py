"""Imports every theme, which fills the registry."""

from tertulia.catalog import (  # noqa: F401
    annotation,
    classifier,
    length,
    preparation,
    satisfaction,
    sentiment,
    topics,
    toxicity,
)
from tertulia.catalog import roundtrips  # noqa: E402, F401  (uses the SQL of the others)
from tertulia.catalog.registry import QUERIES, SQL  # noqa: F401
