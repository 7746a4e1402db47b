"""abode: listing search and listing analytics as Spark DataFrame operators.

Python functions shipped to executors (the Arrow top-k kernel) are pickled
by value, so workers need no installed copy of this package.
"""

import sys as _sys

try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
