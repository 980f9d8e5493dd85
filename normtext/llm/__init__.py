"""Operators for preparing training corpora. Nothing else in the library imports this package.

Functions that run inside Python tasks are pickled by value, so executors need no copy
of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
