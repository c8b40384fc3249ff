"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Functions of this folder travel to the Python workers by value, so that executors need only the public
libraries and not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
