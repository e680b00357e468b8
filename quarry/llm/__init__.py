"""Operators for preparing training corpora: tokenising, cleaning, deduplicating, mixing and searching.

The subpackage is self-contained: nothing else in the library imports it.  Each module documents one operator,
and ``quarry.llm.queries`` registers one query per operator.
"""
