"""Operators of a training-data pipeline over text tables.

Functions that run in tasks are shipped by value, so executors need no copy of
this package, only numpy, pyarrow and the library an operator names.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
