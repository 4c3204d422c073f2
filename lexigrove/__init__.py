"""Structured-text analytics on PySpark: grammars, trees and tree queries as DataFrames."""

__version__ = "0.1.0"
