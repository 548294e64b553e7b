"""Conversational-recommendation analytics as PySpark DataFrame operators.

Ranked lists are always long tables ``(query_id, item_id, rank, score)`` with
``rank`` counted from 1; they are packed into arrays only at a sink.
"""

__version__ = "0.1.0"
