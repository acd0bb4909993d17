"""Operators for preparing language-model training data, one module each, and their registered queries.

Functions of this package are sent to Python workers by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
