"""Vision-data analytics on Spark: annotation tables, overlap joins, evaluation, tracks, search."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with their code, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
