"""Price-comparison analytics on Spark: whole-table DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Pandas functions travel to the executors by value, so a cluster needs no
# copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
