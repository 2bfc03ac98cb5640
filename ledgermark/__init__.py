"""Prepare, vote on and score financial question-answering corpora with Spark.

``functions`` holds Column -> Column builders, ``operators`` DataFrame ->
DataFrame steps, ``sources`` readers and writers, ``streaming`` the
incremental ingest, ``plans`` the end-to-end flows and ``catalog`` the
queries registered against the driver tables.
"""
