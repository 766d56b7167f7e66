"""Operators for preparing training data; nothing else in the library imports this subpackage.

Functions of this subpackage travel to the executors with the job, so the library need not be installed there.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
