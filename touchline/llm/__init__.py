"""Operators for preparing training data: one module for each of them.

Tasks get the package's functions by value, so executors need not have the
repository on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
