"""Latent scaling of documents from pairwise judgements, on Spark.

Functions that run inside executors are shipped by value, so a cluster needs
only the public libraries installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
