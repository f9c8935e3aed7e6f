"""scoreloom: feature tables, scorecards and stacked scores as Spark plans."""

__version__ = "0.1.0"
