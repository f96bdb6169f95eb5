"""Takedown-triage analytics as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function, usable through
``df.transform``. Sub-packages:

``functions``  column expressions and the skew-safe building blocks
``sources``    CSV, Parquet and certificate readers and writers, test views
``operators``  cleaning, profiling, features, evaluation, selection, radar
``plans``      whole jobs built from the operators
``streaming``  the certificate radar on Structured Streaming
"""
