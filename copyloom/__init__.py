"""Cohort copy-number analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the package's helpers by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
