"""Training-data operators.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded hook in
``__spark_entry__.py``) imports it.
"""
