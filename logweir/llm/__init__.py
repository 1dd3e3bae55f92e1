"""Operators for preparing training text at scale. Nothing outside this package imports it.

Functions of this package that run in tasks travel with the task by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

from logweir.sources import files

for _module in (sys.modules[__name__], files):
    cloudpickle.register_pickle_by_value(_module)
