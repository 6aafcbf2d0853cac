"""All registered queries; importing this package fills the registry."""

from . import (contract_queries, feature_queries, graph_queries, message_queries, model_queries,  # noqa: F401
               quality_queries, run_queries, tree_queries, typed_queries)
from .base import ORACLES, QUERIES  # noqa: F401
