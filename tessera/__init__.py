"""tessera: corpus preparation and subword-vocabulary analytics on Spark.

Sub-packages:

* ``sources``   -- corpus, gold-segmentation and model-table readers
* ``functions`` -- per-row Column functions (cleaning, tags, words, pieces)
* ``operators`` -- distributed operators (split, metrics, boundaries,
                   vocabulary learning, encoders, MLM examples)
* ``plans``     -- ready-made query plans over the driver tables
* ``streaming`` -- the stateless cleaning path on a streaming DataFrame
* ``sinks``     -- text / CSV / JSON / parquet writers
"""

from tessera.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
