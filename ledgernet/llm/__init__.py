"""Operators for large-scale training-data preparation.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.  Every
operator takes and returns DataFrames; Python runs only inside Spark tasks,
on Arrow batches, unless the module says otherwise.
"""
