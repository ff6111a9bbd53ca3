"""Listing analytics on Spark: normalisation, rollups, duplicates, matching, market scores, lifecycle, streams."""

import sys

from pyspark import cloudpickle

# Functions of this package reach Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
