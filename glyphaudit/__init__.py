"""Text-encoding audit and conversion as Spark jobs."""

import sys

from pyspark import cloudpickle

# Column helpers travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
