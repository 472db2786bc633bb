"""Typed dataflow graphs over dense pixel and plane data, lowered to DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions by value, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
