"""Spark operators over entity and event data.

The package is registered for pickling by value, so that Python workers need
no copy of it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
