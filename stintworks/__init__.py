"""Entity-season analytics on Spark: land, resolve identity, fold stints, compare entities."""

import sys

from pyspark import cloudpickle

# Functions run by Python workers travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
