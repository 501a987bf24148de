"""Training-data operators: each works on a DataFrame and stays distributed.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
