"""A PySpark engine for conversations and training corpora.

Functions and classes of this package that run on executors are shipped by value, so that executors
need no copy of the package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
