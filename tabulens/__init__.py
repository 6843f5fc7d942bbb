"""Profiling, cleaning and insight operators over Spark DataFrames.

Python functions of the package travel to the executors by value: workers need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
