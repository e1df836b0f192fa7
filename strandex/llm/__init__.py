"""Training-data operators: quality, language, toxicity, sharding, near-dedup, URL rules,
decontamination, WARC, mixing and token counts.

Self-contained: nothing outside this subpackage imports it, and it imports nothing from the rest of
the library.  ``queries`` and ``oracle_sql`` (module ``registry``) are what the entry file registers.
"""
