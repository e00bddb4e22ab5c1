"""Book-corpus analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python workers get the functions they run by value, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
