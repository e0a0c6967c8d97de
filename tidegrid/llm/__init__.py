"""Operators for training-data pipelines: counting, filtering, deduplicating and scoring documents.

Each operator is a function from DataFrame to DataFrame. Nothing outside this folder imports it, except
``corpus_pipeline.py`` and the entry module.
"""

from pyspark import cloudpickle

import tidegrid

# The kernels travel with the plans, so workers need not have this folder on their path.
cloudpickle.register_pickle_by_value(tidegrid)
