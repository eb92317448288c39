"""The registered queries; importing this package registers all of them."""

from paperloom.plans import branches, entities, measures, records, texts  # noqa: F401
from paperloom.plans.registry import ORACLES, QUERIES  # noqa: F401
