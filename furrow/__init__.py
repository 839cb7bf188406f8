"""furrow: seed, normalise, load and analyse business tables on Spark."""

__version__ = "0.1.0"
