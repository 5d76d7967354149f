"""A PySpark engine for ordered key/value data: ranks, zone maps, learned indexes, stores and encodings."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
