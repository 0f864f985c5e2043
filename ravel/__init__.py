"""ravel — code-review analytics on Spark.

DataFrame functions over review, comment, event and training-example tables.
Modules:

* ``ravel.session``    – SparkSession settings (AQE, UTC, checkpoint dir)
* ``ravel.sources``    – table scans, JSON-lines readers, domain views
* ``ravel.functions``  – column helpers that reproduce JavaScript text semantics
* ``ravel.operators``  – the operators, one module per area
* ``ravel.streaming``  – Structured Streaming jobs
* ``ravel.plans``      – the query registry used by ``__spark_entry__`` and bench
"""

__version__ = "0.1.0"
