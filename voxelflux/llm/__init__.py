"""Operators of a training-data pipeline: counting, deduplication, language, quality, secrets, decontamination, mixing.

Nothing else in the library imports this subpackage. `plans.load()` returns the registered queries and their DuckDB texts.
"""
import sys

from pyspark import cloudpickle

#: Functions of this subpackage travel to the executors with the job, so nothing must be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
