"""Session helpers."""
from pyspark.sql import SparkSession


def local_session(name: str = "patronage", cpus: str = "*") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")  # larger methods escape the JIT compiler
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
