"""Operators of a training-data pipeline (secrets, PII, search, joins, scoring, mixing).

Nothing else in the library imports this package.  Functions that run in
Python workers are shipped by value, so executors need no installed copy.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
