"""Operators of a large-scale training-data pipeline.

A self-contained subpackage: nothing outside it imports it, and it imports
nothing from the rest of the library, so it can be removed as a whole.
"""
