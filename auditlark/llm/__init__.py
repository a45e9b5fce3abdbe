"""Training-data operators: formatting, joins, dedup, token counts, decontamination, sampling, classifiers.

Nothing outside this subpackage imports it. Functions that run on executors are pickled by value, so a
cluster needs no deployment of this package beside the driver's copy.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
