"""rankloom: retrieve, rank, explain and evaluate records with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
