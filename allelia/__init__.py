"""Genomic diversity statistics as Spark DataFrame jobs, with operators for training-data corpora beside them."""
