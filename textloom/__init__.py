"""textloom: text analytics, constrained rewriting and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Workers receive the functions of this package by value, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
