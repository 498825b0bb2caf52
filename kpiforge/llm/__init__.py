"""Operators of a training-data pipeline, as Spark jobs over documents, pages and embeddings.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; :mod:`kpiforge.llm.queries` applies each to
its whole table under the names the entry file registers.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
