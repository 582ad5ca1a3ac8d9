"""Table profiling, preparation, model comparison, scoring and attribution on PySpark.

Reports are long-form DataFrames with fixed columns; fitted preparation steps
are ``pyspark.ml`` models, so one pipeline serves training, batch scoring and
streams.
"""

__version__ = "0.1.0"
