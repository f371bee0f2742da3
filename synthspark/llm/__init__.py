"""Operators that prepare training text: each is a set of DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the task, so that workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
