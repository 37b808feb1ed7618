"""Operators for large training-data pipelines; nothing else in the library imports this package.

Task functions are shipped by value, so executors need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
