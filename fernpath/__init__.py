"""Metadata search over very large tables of file-like rows, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors may lack this package on their path; its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
