"""Git history and source-code analytics on Spark.

A work directory of repositories becomes eleven relational tables; history
questions, language classification and syntax-tree queries run over them as
ordinary DataFrame plans.
"""

import sys

from pyspark import cloudpickle

# Functions go to the workers with their task; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from codestrata.dataset import Dataset  # noqa: E402
from codestrata.plans import analyses  # noqa: E402

__all__ = ["Dataset", "analyses"]
