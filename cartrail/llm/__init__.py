"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers whole, so that a job runs
# wherever the driver can import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
