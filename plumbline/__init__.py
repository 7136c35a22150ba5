"""Plumbline: building-code compliance analytics as ordinary Spark jobs.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; batch and
streaming jobs share the same Column functions.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
