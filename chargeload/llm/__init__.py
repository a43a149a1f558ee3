"""Operators for preparing training text and vectors; nothing else in the library imports them.

Functions that run inside tasks travel by value, so executors need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
