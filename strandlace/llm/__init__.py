"""Training-data operators: secrets, licences, deduplication, scoring, packing.

Nothing else in the library imports this subpackage.  ``entries`` holds the
registered queries (``queries()``) and their SQL (``oracle_sql()``).
"""
