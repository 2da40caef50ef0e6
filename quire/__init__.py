"""Quire: document analytics over tables of text runs, on Spark."""

__version__ = "0.1.0"
