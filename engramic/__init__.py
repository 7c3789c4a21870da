"""A PySpark-native engine for records that carry embeddings, tags and access history."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code along: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
