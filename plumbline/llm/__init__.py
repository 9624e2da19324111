"""Operators for preparing training corpora, and their queries.

Functions of this package that run inside tasks travel with the job, so executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
