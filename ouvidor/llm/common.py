"""Things the operators of this subpackage share: scratch tables in the folder that the cluster
names, text access on Arrow batches, and the per-text UDF wrapper.

Shared contract of every operator here
--------------------------------------
* only the named id and text columns are read before a result is built, so extra columns, also ones
  named like a result column, never clash;
* a null text is the empty text;
* a repeated row gives one result row for each of its copies unless the docstring says otherwise;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ouvidor.sources.tables import spread

MOST_BITS = 22  # of a piece's number
CHECKPOINT_KEY = "spark.checkpoint.dir"
#: While a scratch table is written: shuffle files go with the write, and texts reach Python a few at a time, as a batch is held by the JVM and by Python.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_made: dict[str, list[str]] = {}
_paths: dict[int, tuple] = {}  # of frames that are still referenced


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; one of our own only where it is unset and the session is local."""
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ouvidor-checkpoint-")
        spark.conf.set(CHECKPOINT_KEY, root)
    return root.rstrip("/")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once to a table in the shared scratch folder and read it back: the lineage ends there,
    so work before it runs once and a lost executor costs no more than the stage it was in."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/ouvidor-tables/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path, compression=codec)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if not _made:
        atexit.register(_release_at_exit)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out, lambda _, key=id(out): _paths.pop(key, None)), path)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete the scratch table behind a frame that materialise() returned, once nothing reads it any more; other frames have none."""
    spark = df.sparkSession
    found, path = _paths.get(id(df), (lambda: None, None))
    made = _made.get(spark.sparkContext.applicationId, [])
    if found() is df and path in made:
        _delete(spark, path)
        made.remove(path)


def release(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it when the results have been written."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _release_at_exit() -> None:
    """What results may still have read goes with the driver's process, if its session is open then."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the session's JVM may be gone
            release(spark)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop shuffle files of frames that are no longer referenced."""
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def text_of(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def strings(array: pa.Array):
    """The texts of an Arrow string array one at a time; null is empty."""
    for value in array:
        yield value.as_py() or ""


def per_text(row, schema: str):
    """An Arrow UDF that maps each text on its own by ``row(text) -> tuple`` to a struct of ``schema`` (DDL)."""
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_type

    types = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(texts: pa.Array) -> pa.Array:
        rows = [row(t) for t in strings(texts)]
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], type=kind) for i, (_, kind) in enumerate(types)],
            names=[name for name, _ in types],
        )

    return F.arrow_udf(run, returnType=fields)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def piece_bits(spark: SparkSession, total: int, each: int) -> int:
    """Bits of a hash range's number: so many ranges that one has about ``each`` of ``total``, and one for each shuffle partition at least."""
    return min(MOST_BITS, max(3, (shuffle_partitions(spark) - 1).bit_length(), (-(-total // each) - 1).bit_length()))
