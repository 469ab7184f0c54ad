"""Corpus operators for training data. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: no copy of the package is needed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
