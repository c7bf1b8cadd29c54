"""quorate: annotation analytics on Spark DataFrames."""

from quorate.registry import DEFAULT_REGISTRY, Indicator, Registry

__all__ = ["DEFAULT_REGISTRY", "Indicator", "Registry"]
