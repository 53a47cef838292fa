"""Faultline: code-security analytics over tables of source files, on Spark."""

__version__ = "0.1.0"
