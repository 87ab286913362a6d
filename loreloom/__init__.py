"""Document knowledge-base analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their task, so the package
# needs no installation on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
