"""cairn: a PySpark-native engine for provenance-carrying knowledge graphs.

Facts, entities, typed measurements and text live in DataFrames; every
operator declares a logical plan and leaves the physical strategy to Catalyst.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers of a cluster need not have the package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
