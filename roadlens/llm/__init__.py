"""Operators of a training-data pipeline over the ``documents`` / ``pages`` tables.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Functions that run
on executors are pickled by value, so workers need no copy of the package.
"""

from pyspark import cloudpickle as _cp
import sys as _sys

_cp.register_pickle_by_value(_sys.modules[__name__])
