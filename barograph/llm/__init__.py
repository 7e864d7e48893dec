"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get the functions of this subpackage with their closures, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
