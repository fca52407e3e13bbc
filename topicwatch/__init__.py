"""topicwatch — topic-monitoring analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame(s) + arguments -> DataFrame``.
Nothing collects, nothing reads the clock (``now`` is always an argument) and
nothing caches; callers decide when to act.
"""

__version__ = "0.1.0"
