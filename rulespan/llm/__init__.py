"""Operators for preparing training corpora; nothing else in the library imports this package.

The modules' functions travel to the executors by value, so that a cluster needs no
installed copy of the package.
"""

import importlib

from pyspark import cloudpickle

_MODULES = (
    "common", "knn_join", "jaccard_join", "html_extract", "token_counts", "secret_scan",
    "source_mixing", "warc", "line_dedup", "decontamination", "quality",
)

for _name in _MODULES:
    cloudpickle.register_pickle_by_value(importlib.import_module(f"{__name__}.{_name}"))
