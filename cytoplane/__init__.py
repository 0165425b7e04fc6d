"""Spatial single-cell analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the workers by value, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
