"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Every operator takes a DataFrame and
column names and returns a DataFrame; the module ``queries`` registers the
contract queries on top of them.  Functions that run inside executors are
shipped by value, so a cluster needs only the public libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
