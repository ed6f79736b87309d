"""The registered queries: importing the package registers every family."""

import importlib

for _family in ("pit", "features", "regimes", "portfolio", "statistics", "models", "walkforward", "forecasts", "weekly"):
    importlib.import_module(f"pit_engine.plans.{_family}")
