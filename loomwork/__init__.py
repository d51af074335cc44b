"""Loomwork: document retrieval and corpus preparation as PySpark plans."""
