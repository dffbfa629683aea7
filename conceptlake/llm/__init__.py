"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it; ``conceptlake.llm.registry`` holds the
queries and their SQL.
"""
