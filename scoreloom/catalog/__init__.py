"""All registered queries."""

from importlib import import_module

from .registry import REGISTRY, Query

# In the order of the survey: sources, cleaning, aggregates, history, encoding, scorecard, models, plans.
MODULES = ("tables", "cleaning", "aggregates", "history", "encoding", "scoring", "learners", "optima", "blocks")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return REGISTRY
