"""docweave: a document and knowledge-graph analytics engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from docweave.config import EngineConfig

# Python functions travel to the executors by value, so a cluster needs no
# separate installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["EngineConfig"]
