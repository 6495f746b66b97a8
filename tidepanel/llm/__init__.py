"""Training-data operators: filtering, deduplication, search, archives and tokenisation on Spark.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
