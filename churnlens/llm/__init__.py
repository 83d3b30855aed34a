"""Operators of a training-data pipeline (tokenisation, deduplication, classifiers, mixing).

Nothing else in the library imports this subpackage.  Every operator is a Spark job over a
DataFrame of documents; NumPy and Arrow appear only inside tasks, on bounded batches.
"""
