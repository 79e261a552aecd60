"""Operators of a training-data pipeline over documents and pages.

Functions of this subpackage that run in Python tasks are sent with the tasks, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
