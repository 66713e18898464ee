"""Sessions for tests and benchmarks, and getting the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int = 8, partitions: int = 8, name: str = "grovemark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("GROVEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers, once per application, so that it need not be installed on executors."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.NamedTemporaryFile(suffix=".zip", prefix="grovemark-", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for path in sorted(root.rglob("*")):
                if path.suffix in (".py", ".toml"):
                    z.write(path, f"{root.name}/{path.relative_to(root)}")
        spark.sparkContext.addPyFile(f.name)
        _shipped.add(app)
    return spark
