"""Operators of a training-data pipeline: filtering, deduplication, decontamination, packing.

Nothing outside this folder imports it; ``queries`` holds the registered queries.
"""
