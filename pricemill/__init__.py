"""Retail pricing analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from pricemill.params import Policy

# The few functions that run in Python workers travel with the job, so that executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Policy"]
