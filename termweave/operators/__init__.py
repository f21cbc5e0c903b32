"""Operators on DataFrames: profiles, search, features and orders, scopes, measures, model order."""

from .metrics import evaluate
from .model_rank import ask, merge
from .profiles import compose_profiles, scan_profiles
from .ranking import batch_score, by_keys, by_near_ties, by_relevance, by_rules, enriched, gated_score, jaccard, minmax, pair_features, plain, side
from .scope import allowlist, drop_classes, scope_ids, scoped_first
from .search import max_similarity, mean_pooled, nearest

__all__ = ["allowlist", "ask", "batch_score", "by_keys", "by_near_ties", "by_relevance", "by_rules", "compose_profiles", "drop_classes", "enriched", "evaluate", "gated_score", "jaccard", "max_similarity", "mean_pooled", "merge", "minmax", "nearest", "pair_features", "plain", "scan_profiles", "scope_ids", "scoped_first", "side"]
