"""Training-data operators: extraction, deduplication, mixing, scoring, search and packing.

Nothing outside this package imports it; ``queries.py`` lists its queries and their SQL.
"""
