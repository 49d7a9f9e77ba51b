"""Operators of a training-data pipeline over documents and web pages.

Nothing outside this package imports it; ``queries.py`` registers its queries.
"""
