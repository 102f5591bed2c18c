"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. ``queries.py`` lists the registered
queries and ``oracle.py`` their DuckDB SQL.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
