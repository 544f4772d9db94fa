"""Documentation retrieval and training-data preparation on PySpark."""

from pathlib import Path


def ensure_importable(spark) -> None:
    """Lets Python workers import this package where the driver found it; on a cluster it is shipped with --py-files."""
    environment, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    paths = environment.get("PYTHONPATH", "").split(":")
    if here not in paths:
        environment["PYTHONPATH"] = ":".join([here, *filter(None, paths)])


def spread(df):
    """A scan of fewer splits than the cluster has cores, over all cores; such a scan is small, others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
