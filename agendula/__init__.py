"""A listings and corpus engine expressed in PySpark DataFrames."""
