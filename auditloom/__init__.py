"""Review analytics on Spark: corpora, model-written reports, votes, gates and exports."""

import sys

from pyspark import cloudpickle

# Python tasks carry the few helpers they need, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
