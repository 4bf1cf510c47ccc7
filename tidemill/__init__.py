"""Panel time-series analytics on Spark.

Every operator is a function ``DataFrame -> DataFrame`` over a *panel*: many
series in one frame, identified by ``keys`` (possibly none), ordered by ``ts``
and measured by ``y``.
"""
