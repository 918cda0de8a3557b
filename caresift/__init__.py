"""caresift: build, search and evaluate health question-answering corpora on Spark.

Every operator is a function over DataFrames or Columns.  Nothing here holds data on the driver: operators
return lazy DataFrames, and the few that must look at sizes first say so in their docstring.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they need, so the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from caresift.session import build_session, cut_lineage  # noqa: E402

__all__ = ["build_session", "cut_lineage"]
