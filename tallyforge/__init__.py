"""A Spark-first analytics engine for stratified arithmetic benchmarks and what models make of them."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
