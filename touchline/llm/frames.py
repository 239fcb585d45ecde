"""Small helpers to run per-document work on Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and about so many bytes, handed to the per-document code at once.
ROWS = 512
BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local session without the setting gets one under its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back (lineage ends there)."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc_id, text: what the text operators read of a table."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fit = BYTES * batch.num_rows // max(batch.nbytes, 1)
        step = max(1, min(ROWS, fit))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def arrow_map(
    df: DataFrame, work: Callable[[pa.RecordBatch], dict], schema: str,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``work`` gives new columns (name: values) for a slice of rows.

    The columns in ``carry`` go along unchanged.  Rows are neither moved nor
    gathered: one slice is in memory at a time.
    """
    spark = df.sparkSession
    added = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    kept = [f for f in df.schema.fields if f.name in carry]
    out = type(df.schema)([*kept, *added.fields])
    kinds = {f.name: to_arrow_type(f.dataType) for f in added.fields}

    def run(batches):
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            new = work(batch)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(f.name)) for f in kept),
                 *(pa.array(new[n], kind) for n, kind in kinds.items())],
                [*(f.name for f in kept), *kinds])

    return df.mapInArrow(run, out)


def bitmap(words: DataFrame, size: int) -> np.ndarray:
    """A bitmap of ``size`` bits on the driver, as 64-bit words.

    ``words`` has word (a place) and mask (its bits), any number of rows for a
    place.  Spark joins the rows of a place; they come as a few blobs of 16 bytes a
    word, so that at most ``size / 4`` bytes are gathered, whatever the data.
    """
    def pack(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(k).to_numpy(zero_copy_only=False).tobytes()])
                 for k in range(2)], ["word", "mask"])

    rows = words.groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(size // 64, np.int64)
    for word, mask in rows.mapInArrow(pack, "word binary, mask binary").collect():
        out[np.frombuffer(word, np.int64)] = np.frombuffer(mask, np.int64)
    return out.view(np.uint64)


def words_of(bits: np.ndarray) -> pa.RecordBatch:
    """The words of a part of a bitmap that have bits, as rows for ``bitmap``."""
    used = np.flatnonzero(bits)
    return pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(bits[used].view(np.int64))], ["word", "mask"])


def set_bits(bits: np.ndarray, hashed: np.ndarray) -> None:
    """Set the bit of each 64-bit hash (the size of the bitmap is a power of two)."""
    at = hashed & np.uint64(64 * len(bits) - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64),
                     np.uint64(1) << (at & np.uint64(63)))


def has_bits(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    at = hashed & np.uint64(64 * len(bits) - 1)
    return bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1


#: Bits of a bitmap of keys (4 MB, whatever their number), and those in one of its rows.
KEY_BITS = 1 << 25
ROW_BITS = 1 << 12


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of all columns of a row (maps and variants as JSON)."""
    def plain(kind: T.DataType) -> bool:
        if isinstance(kind, T.ArrayType):
            return plain(kind.elementType)
        if isinstance(kind, T.StructType):
            return all(plain(f.dataType) for f in kind.fields)
        return not isinstance(kind, (T.MapType, T.VariantType))

    return F.xxhash64(*[
        F.col(f"`{f.name}`") if plain(f.dataType)
        else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema.fields])


def key_bitmap(hashes: DataFrame) -> DataFrame:
    """A bitmap as a table (row, bits) with the bits of the hashes in column ``hash``.

    It has ``KEY_BITS / ROW_BITS`` rows at most, so it can always be broadcast.
    """
    bit = F.col("hash").bitwiseAND(F.lit(KEY_BITS - 1))
    words = (hashes.select(bit.alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 AS int))")).alias("mask")))
    per_row = ROW_BITS // 64
    masks = F.map_from_entries(F.collect_list(F.struct(
        (F.col("word") % per_row).cast("int").alias("at"), "mask")))
    return (words.groupBy(F.floor(F.col("word") / per_row).alias("row")).agg(masks.alias("masks"))
            .select("row", F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.coalesce(
                F.try_element_at("masks", i), F.lit(0).cast("long"))).alias("bits")))


def with_bit(rows: DataFrame, hashed: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether the bitmap has the hash's bit (so its key may be there)."""
    at, row, bits = (fresh(n, rows) for n in ("_at", "_bitmap_row", "_bits"))
    found = rows.withColumn(at, hashed.bitwiseAND(F.lit(KEY_BITS - 1))).join(
        F.broadcast(bitmap.select(F.col("row").alias(row), F.col("bits").alias(bits))),
        F.shiftright(at, ROW_BITS.bit_length() - 1) == F.col(row), "left")
    word = F.get(F.col(bits), (F.shiftright(at, 6) % (ROW_BITS // 64)).cast("int"))
    return found.withColumn(name, F.coalesce(
        F.getbit(word, (F.col(at) % 64).cast("int")) == 1, F.lit(False))).drop(at, row, bits)


def text_key(docs: DataFrame) -> Column:
    """What a verdict on a text is kept by: the row's doc_id, and a hash of its text."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"),
                    F.xxhash64(F.col("text").cast("string")).alias("text"))


def without(docs: DataFrame, key: Column, lost: DataFrame,
            once: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is not in ``lost`` (column key, a stored
    table), all columns unchanged; of rows with a key in ``once`` one stays.

    Texts stay where they are: only rows that a bitmap of these keys lets through are
    shuffled, to be compared with the keys themselves.
    """
    name, maybe = fresh("_key", docs), fresh("_maybe", docs)
    keys = lost.select("key") if once is None else lost.select("key").union(once.select("key"))
    rows = with_bit(docs.withColumn(name, key), F.xxhash64(F.col(name)),
                    key_bitmap(keys.select(F.xxhash64("key").alias("hash"))), maybe)
    doubtful = rows.filter(F.col(maybe)).join(
        lost.select(F.col("key").alias(name)).hint("merge"), name, "left_anti")
    if once is not None:
        doubtful = doubtful.dropDuplicates([name])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(~F.col(maybe)).select(*columns).unionByName(doubtful.select(*columns))
