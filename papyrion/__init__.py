"""Papyrion: a document-SQL analytics engine that plans everything as Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# What runs in Python workers travels by value: executors need not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
