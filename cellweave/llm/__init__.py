"""Training-data operators: near-duplicates, chat rendering, secret scans, language models, extraction, mixing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.  Functions of this subpackage are pickled by
value, so executors need neither the package on their path nor a shared local folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
