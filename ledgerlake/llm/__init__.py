"""Operators for training data: the whole subpackage can be removed without touching the rest."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel with the jobs, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
