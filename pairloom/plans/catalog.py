"""All registered queries; importing a family registers it."""

from pairloom.plans import (  # noqa: F401
    q_aggregates,
    q_filters,
    q_functions,
    q_joins,
    q_metrics,
    q_qa,
    q_ranking,
    q_rowdiff,
    q_setops,
    q_sources,
    q_splits,
)
from pairloom.plans.registry import ORACLES, QUERIES  # noqa: F401
