"""Streams with batch twins."""

import sys

from pyspark import cloudpickle

# Python workers get state machines by value, so executors need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
