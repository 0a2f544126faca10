"""Operators for preparing training data; each works on whole tables, in Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that use them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
