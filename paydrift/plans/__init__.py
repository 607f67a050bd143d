"""Named queries over the given tables and their SQL checks."""

from importlib import import_module

MODULES = ("core", "movement", "monthly", "scalars", "yoy", "attraction", "triggers", "feed", "anomaly", "worklist", "watch", "cascade", "long_history", "backtest", "forecast_grid")


def load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
