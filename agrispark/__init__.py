"""agrispark: field-analytics operators as Spark DataFrame jobs.

Every public operator takes and returns ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar functions) and is written with native column
expressions so Catalyst can prune, push down and codegen the plan.

Layout
------
``sources``    scans, JSON-map sources, sinks, metrics history, model bundles
``functions``  narrow ``Column`` expressions (coercion, zones, scores, text)
``operators``  schema checks, filters, joins, aggregations, windows, ranking,
               feature preparation, oversampling, data quality
``ml``         MLlib training / scoring jobs
``plans``      demo views over the driver tables, composed jobs, query registry
``streaming``  bounded-input guards (the reference has no streaming)
"""

__version__ = "0.1.0"
