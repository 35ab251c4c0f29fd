"""pixelloom: analytics over large media catalogues, declared on Spark DataFrames.

Subpackages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame),
``sources`` (files to DataFrame), ``streaming`` (incremental forms) and ``plans`` (named queries
with their SQL oracles).  Every operator selects the columns it needs at its start, so extra
columns of the caller's tables can neither clash with internal names nor widen a shuffle.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value, so a cluster needs no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
