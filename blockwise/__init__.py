"""Blockwise: entity resolution over ambiguous-name blocks, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel by value, so that the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
