"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Functions sent to executors are
pickled by value, so executors need only the third-party libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
