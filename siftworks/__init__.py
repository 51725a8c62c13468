"""Data-quality and training-data operators as PySpark DataFrame functions."""
