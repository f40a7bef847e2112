"""Operators for training-data pipelines, each by the method its module names.

Functions of this package travel to the executors by value, so that a session
whose workers lack the repository on their path can run them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
