"""The engine's queries; importing this package registers them."""

from folio.plans import aggregating, joining, maintaining, moving, normalise, ordered, streams  # noqa: F401
from folio.plans.registry import QUERIES, SQL  # noqa: F401
