"""Runnable jobs: each module has ``run(spark, ...)`` and a command line.

They read and write through Spark alone, so every path may be remote.
"""
