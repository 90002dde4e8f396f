"""Spark operators for building semi-supervised text-classification datasets."""

__version__ = "0.1.0"
