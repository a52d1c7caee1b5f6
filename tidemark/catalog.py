"""All queries of the package, with the SQL that each must agree with."""

from importlib import import_module

from .registry import ORACLES, QUERIES

MODULES = (
    "sources.frames", "sources.landing", "sources.incremental", "functions.scalars", "functions.windows", "functions.ranks", "functions.records", "functions.normalize", "functions.pairs", "operators.asof", "operators.lags", "operators.flows", "operators.aggregates", "operators.relational",
    "operators.data_quality", "operators.scores", "operators.replay", "plans.indicators", "plans.recursive", "plans.backtest", "plans.portfolio", "plans.reports", "plans.performance", "plans.engines", "plans.factors", "plans.strategies", "plans.patterns", "plans.rules", "plans.alerts", "plans.templates", "streaming.alert_state", "streaming.timed",
)


def _load() -> None:
    for module in MODULES:
        import_module(f"tidemark.{module}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(ORACLES)
