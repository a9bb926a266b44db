"""Schemas, and tables written to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BODIES = "array<struct<subType:string,distanceToArrival:float,mainStar:boolean,population:bigint>>"
RAW_SYSTEM = f"name string, coords struct<x:float,y:float,z:float>, bodies {BODIES}"
STARS = "star_id long, name string, x float, y float, z float"
JUMP = "timestamp string, event string, StarSystem string, SystemAddress long, StarPos array<double>, JumpDist double, FuelUsed double, FuelLevel double"
ROUTE_NODE = "struct<system:struct<name:string,coords:struct<x:double,y:double,z:double>>,distance:double,refuel:boolean,isNeutron:boolean>"
STORED_ROUTE = f"nodes array<{ROUTE_NODE}>, progress double"


class NoSharedFolder(RuntimeError):
    pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where it is unset, a session of one machine gets a folder of this process;
    on a cluster that would scatter a table over the executors' own disks, so
    there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise NoSharedFolder(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="waymark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session is gone: its folder goes with the cluster
        pass


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/waymark-{tag}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, so a lost executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
