"""Spark-native analytics over labelled URL tables and text corpora."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code along, so workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
