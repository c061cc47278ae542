"""Spark-native exploration of multi-channel image tiles, embeddings and cluster labels.

Every operator takes DataFrames and returns a DataFrame.  The logical tables are

* ``cells(id, X_centroid, Y_centroid, clustering, umap2_*, umap3_*, cluster_L*, rank_L*)``
* ``features(id, embedding)``
* ``pixels(channel, id, y, x, value)`` or packed ``tiles(channel, id, chunk_id, pixels)``
* ``annotations(id, <free columns>)``

plus the small dimensions ``channels``, ``cluster_labels`` and ``reviews``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
