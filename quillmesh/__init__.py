"""A PySpark-native engine for graphs of linked notes, search and retrieval."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers by value: executors then need
# no copy of the package, only its public dependencies.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
