"""Small helpers the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shuffle_parts(spark: SparkSession) -> int:
    """The session's shuffle parallelism, for explicit repartitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; one of this machine only where all run on it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, place: str) -> None:
    """Remove a table of the shared folder that no plan reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_table(df: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """df as a table in the shared checkpoint folder, compressed and free of its lineage."""
    spark = df.sparkSession
    path = place or new_place(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Documents and bytes of text that share a range or bucket, on average.
RANGE_ROWS, RANGE_BYTES = 4096, 16 << 20
#: Partitions that ranges are dealt to at most, many to one beyond.
MOST_PARTITIONS = 20_000


def ranges_of(docs: DataFrame, text: str = "text") -> int:
    """Ranges for work on all texts: as many as the shuffle has partitions, or rows or bytes ask for."""
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return max(shuffle_parts(docs.sparkSession), rows // RANGE_ROWS, size // RANGE_BYTES)


def by_spot(packed: DataFrame, ranges: int) -> DataFrame:
    """Packed rows of one range together, ranges in order of `spot`; rows written aside go by theirs."""
    return packed.repartition(min(ranges, MOST_PARTITIONS), F.abs("spot")).sortWithinPartitions("spot")


def held_out(doc_id: Column) -> Column:
    """The fixed test fold: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def append_arrow(df: DataFrame, fn, fields: str) -> DataFrame:
    """df with further columns that fn computes per Arrow batch; columns of those names are replaced.

    fn takes an iterator of record batches and yields, for each in turn, its list of new arrays.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    new = T._parse_datatype_string(fields)
    kept = [f for f in df.schema.fields if f.name.lower() not in {x.name.lower() for x in new.fields}]
    names, order = [f.name for f in kept], [f.name for f in kept] + [f.name for f in new.fields]

    def run(batches):
        for batch, arrays in fn(batches):
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + arrays, names=order)

    return df.mapInArrow(run, T.StructType(kept + new.fields))


#: What was written aside is gathered to about so many bytes; a range of more is thinned.
APART_BYTES, THIN_BYTES = 16 << 20, 64 << 20


def in_ranges(together, apart, thin=None):
    """For mapInArrow over partitions sorted by `spot`: together(table) of the rows of each spot from 0
    on, one spot held at a time, and apart(table) of the rows of each negative spot, in pieces of
    APART_BYTES, as those of one spot have no bound. thin(table) gives what can be told of a spot
    already and the rows that must still be held; it is asked whenever they have doubled beyond THIN_BYTES."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, at, size, most = [], None, 0, THIN_BYTES

        def done():
            if held:
                yield from (together if at >= 0 else apart)(pa.Table.from_batches(held)).to_batches()

        for batch in batches:
            spots = batch.column(batch.schema.get_field_index("spot")).to_numpy()
            cuts = [0, *(np.flatnonzero(spots[1:] != spots[:-1]) + 1).tolist(), len(spots)] if len(spots) else []
            for a, b in zip(cuts, cuts[1:]):
                if spots[a] != at or (at < 0 and size > APART_BYTES):
                    yield from done()
                    held, at, size, most = [], spots[a], 0, THIN_BYTES
                held.append(batch.slice(a, b - a))
                size += held[-1].nbytes
                if thin is not None and at >= 0 and size > most:
                    told, kept = thin(pa.Table.from_batches(held))
                    yield from told.to_batches()
                    held = kept.to_batches()
                    size = sum(x.nbytes for x in held)
                    most = max(THIN_BYTES, 2 * size)
        yield from done()

    return run
