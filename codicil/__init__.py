"""Document retrieval, answer audit and operations analytics as Spark jobs.

Every public function takes and returns DataFrames (or Columns); nothing is
collected to the driver except side inputs whose size has been checked first.
"""

import sys

from pyspark import cloudpickle

# Arrow functions travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
