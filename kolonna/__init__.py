"""A PySpark-native analytics engine for append-only event tables: one ``select`` verb over typed, partitioned tables."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
