"""Training-data operators over document, page and conversation tables.

Each module holds one operator; ``queries`` registers them over the test tables
and ``sql`` states the same results for DuckDB where SQL can. Nothing else in the
library imports this package.
"""
