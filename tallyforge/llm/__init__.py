"""Operators for preparing language-model training data; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that the package needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
