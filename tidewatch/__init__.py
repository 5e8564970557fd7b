"""Token screening and rotation analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel whole, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
