"""Operators for large-scale preparation of training text.

The functions that run in Python workers travel with their job, so executors need the
installed libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
