"""Log-stream analytics on Spark: tail, parse, aggregate and report growing log files."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so that these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
