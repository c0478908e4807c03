"""Operators of a training-data pipeline: scoring, mixing, deduplication, extraction and output.

Each module holds one operator with its own interface; ``registry`` turns them into the
contract queries.  Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors with their code, so a cluster needs no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
