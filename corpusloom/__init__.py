"""Retrieval and retrieval-augmented generation over tables, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
