"""Operators for large-scale training-data pipelines.

Nothing else in the package imports this one.  Every operator takes DataFrames
and returns DataFrames; state that must survive a lost executor is written to
the shared folder named in ``spark.checkpoint.dir`` (see ``common.Work``).
"""
