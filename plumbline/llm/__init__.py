"""Operators of a training-data pipeline. Nothing else in the library imports this package.

Every operator takes a DataFrame and the names of the columns it reads, selects just those, and
so does not mind further columns. Intermediate tables go to the folder that
``spark.checkpoint.dir`` names (see ``plumbline.operators.staging``).
"""
