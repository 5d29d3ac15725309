"""tickscope: a Spark-native engine for unusual behaviour in market-style bar data.

Bars -> rolling features -> isolation-forest scores + trend/seasonality band ->
per-series and consensus anomaly flags -> portfolio analytics, alerts, streaming.
Every operator is a ``DataFrame -> DataFrame`` function; see ``plans.catalog``.
"""

__all__ = ["session", "schemas"]
