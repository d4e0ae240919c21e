"""corpusflow: a PySpark library for ingesting, cleaning, de-duplicating,
embedding and querying a corpus of syndicated articles.

Every public operator takes and returns Spark DataFrames or Columns; nothing is
collected to the driver.
"""

__version__ = "0.1.0"

import sys as _sys

try:  # ship our UDF bodies by value so executors need no install of this package
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
