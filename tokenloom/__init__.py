"""Spark jobs that prepare, pack and noise token data and post-process model output."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
