"""briskbi: business-table analytics as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Grouped-map and map-in-pandas functions reference helpers of this package;
# pickling the package by value lets executors run them without installing it.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
