"""Semantic deduplication, outlier filtering and representative selection on Spark DataFrames."""

from tessera.functions.encoders import CallableEncoder, HashedBigramEncoder, TableEncoder
from tessera.operators.diversify import Strategy
from tessera.plans.index import SemanticIndex
from tessera.plans.results import DeduplicationResult, FilterResult

__all__ = ["CallableEncoder", "DeduplicationResult", "FilterResult", "HashedBigramEncoder", "SemanticIndex", "Strategy", "TableEncoder"]
