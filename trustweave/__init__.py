"""Trust evidence for groups of sources, as Spark DataFrame operators."""

__version__ = "0.1.0"
