"""Full-text retrieval and ranking on Spark."""

__version__ = "0.1.0"
