"""Operators for preparing training corpora (quality rules, near-duplicates,
decontamination, PII, packing, sharding, URL and license rules, WARC, chat).

Nothing outside this subpackage, ``corpus_pipeline.py`` and the guarded part
of ``__spark_entry__.py`` imports it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this subpackage travel to the Python workers by value, so the
# executors need not have the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
