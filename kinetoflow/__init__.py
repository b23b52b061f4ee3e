"""Editing-state analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python functions that Spark sends to executors travel by value: no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
