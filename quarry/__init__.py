"""Profiling tables and compressing them by description, on Spark.

``quarry.plans.pipeline`` has the entry points ``compress``, ``decompress`` and ``validate_pair``.
"""
