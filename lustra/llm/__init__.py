"""Operators for training-data pipelines: filtering, masking, mixing, formatting, archives and duplicates."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job: the package need not be installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
