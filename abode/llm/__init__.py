"""Training-data operators: filters, counts, scores, duplicates, mixing.

Nothing else in the library imports this subpackage.  Its functions are
pickled by value, so Python workers need no installed copy of it.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
