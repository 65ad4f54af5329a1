"""Relational analytics for two-person sensor sessions, on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Executors need not have this package installed: functions sent to Python
# workers travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
