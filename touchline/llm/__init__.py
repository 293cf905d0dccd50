"""Training-data operators: extraction, classification, deduplication, mixing and packing of large text corpora.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
