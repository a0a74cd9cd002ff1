"""Spark-native analytics on measurement data, and operators for training-data corpora.

Functions of this package that run in Python workers travel by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
