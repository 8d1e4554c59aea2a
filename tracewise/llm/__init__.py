"""Operators for preparing training data at scale (documents, embeddings).

Nothing outside this subpackage imports it. Functions that run in Python
workers are pickled by value, so workers need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
