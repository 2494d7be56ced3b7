"""Conversation-log analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# the few functions that run in Python workers travel with the job, so that
# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
