"""Operators for large training-data pipelines. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a cluster needs no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
