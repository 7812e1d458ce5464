"""Training-data operators: quality, duplicates, secrets, scoring, extraction, packing, pieces.

Nothing else in the library imports this subpackage; it imports only ``pyspark``, ``numpy``,
``pyarrow`` and the compression / hashing wheels it names.
"""
