"""millrace: a Spark-native engine for preparing, auditing and scoring text corpora."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that no executor needs this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
