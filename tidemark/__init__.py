"""Market-data analytics as plain DataFrame -> DataFrame functions on Spark."""

import sys

from pyspark import cloudpickle

# grouped maps and Arrow functions travel to executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
