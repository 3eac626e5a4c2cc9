"""Spark-native genomic signal analytics: reads, intervals and binned tracks as DataFrames."""

from pathlib import Path

__version__ = "0.1.0"


def reachable(spark):
    """Lets Python workers import this package from where the driver has it, unless the session already says where to look."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    known = sc.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")
    return spark
