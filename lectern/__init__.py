"""lectern: analytics over recognised speech and its transcripts, as Spark plans."""

import sys

from pyspark import cloudpickle

# Workers get the package's functions by value: no executor needs the repository on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
