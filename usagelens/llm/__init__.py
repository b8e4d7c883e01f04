"""Operators for preparing training text.

Tasks carry the code of this subpackage with them (pickled by value), so
executors need Spark, numpy and pandas but not this library.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
