"""Operators for preparing training text: packing, scoring, deduplication, mixing and the like.

Nothing else in the library imports this subpackage.
"""
