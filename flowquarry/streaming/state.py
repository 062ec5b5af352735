"""Session and reader for streams that keep keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")
#: Packs of rows pass between Spark and its Python workers; a batch is bounded by its bytes, and state is read a few elements at a time.
BATCHES = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
    "spark.sql.execution.arrow.transformWithStateInPySpark.maxStateRecordsPerBatch": "64",
}


def state_session(spark: SparkSession) -> SparkSession:
    """Session on the same cluster whose streams keep state in RocksDB, which map state and timers need.

    The given session's settings stay as they are.
    """
    session = spark.newSession()
    for name in CARRIED:
        value = spark.conf.get(name, None)
        if value is not None:
            session.conf.set(name, value)
    for name, value in {PROVIDER_CONF: ROCKSDB, **BATCHES}.items():
        session.conf.set(name, value)
    return session


def read_state(spark: SparkSession, checkpoint: str, variable: str | None = None) -> DataFrame:
    """Rows of the state of a stream's first stateful operator after its last batch, or of one state variable of it."""
    reader = spark.read.format("statestore")
    if variable is not None:
        reader = reader.option("stateVarName", variable)
    return reader.load(checkpoint)
