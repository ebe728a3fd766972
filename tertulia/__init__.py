"""Conversation-corpus analytics as Spark DataFrame jobs."""

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# functions sent to Python workers travel with their code, so that executors need no
# copy of this package on their path
register_pickle_by_value(sys.modules[__name__])
