"""Training-data operators: toxicity, line and exact de-duplication, license and secret scans,
n-gram similarity joins, quality rules, packing, BPE coding and URL filters.

Nothing outside this package imports it; ``queries.py`` lists the registered queries."""
