"""Operators for preparing training data.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
