"""Landmark matching and its analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# tasks get this package's functions with the job, so that executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
