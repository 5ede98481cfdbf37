"""Training-data operators: scoring, search, mixing, deduplication, decontamination, sharding, WARC.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries when it is present.
"""
