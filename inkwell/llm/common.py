"""What the corpus operators share: stage outputs on shared storage, word rules, salts."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.sources.shared import shared_dir

#: A side of a join is broadcast only after it has been counted and measured: at most so many rows and bytes.
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 48 << 20

#: ASCII separators of the word rule; every other character belongs to a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spelled(capitals: bool) -> str:
    """WORD (with capitals too), each separator named: Java looks single characters up in a table, but compares ranges one by one."""
    return "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not (chr(c).isalnum() and (capitals or not chr(c).isupper()))) + "]++"


#: The word rule for Java's expressions, of a text in lower case and of one that still has its capitals.
SPELLED_WORD, SPELLED_WORD_AS_IT_IS = _spelled(False), _spelled(True)


def ship(module_name: str) -> None:
    """Send the functions of a module to the executors by value, so that they needn't have the library installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def session_dir(spark: SparkSession) -> str:
    """Where this application's intermediate tables and ledgers lie: a folder of its own below the shared one."""
    return f"{shared_dir(spark)}/inkwell/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete the application's intermediate tables. Results are lazy, so call it after they have been read or written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors, gives true sizes.

    narrow: a table of ids or counts, for which four files a core are enough; every file costs a commit and a later open.
    The table stays until ``clear`` is called.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(field) -> Column:
    """Bytes of a column's value: strings and binaries by length, other values as 8, arrays of strings by their sum."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        inner = F.transform(c, lambda x: F.octet_length(x.cast("string")) + 8) if isinstance(field.dataType.elementType, T.StringType) else F.transform(c, lambda x: F.lit(16))
        return F.coalesce(F.aggregate(inner, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(8))), F.lit(0))
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a written table stays under both bounds; no more than rows + 1 of its rows are looked at."""
    per_row = sum((_bytes(f) for f in df.schema.fields), F.lit(16)).cast("long")
    n, held = df.limit(rows + 1).select(per_row.alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).head()
    return n <= rows and held <= size


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast of a written side that stays under the bounds; else the join shuffles (and AQE splits hot keys)."""
    return F.broadcast(df) if is_small(df, rows, size) else df.hint("shuffle_merge")


def row_key(*cols: Column) -> list[Column]:
    """Two 64-bit hashes, r1 and r2, that stand for the columns' values; never null, equal for repeated rows."""
    return [F.xxhash64(*cols).alias("r1"), F.xxhash64(F.lit("second"), *cols).alias("r2")]


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII texts take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def words_of(text: Column) -> Column:
    """The words of a text, in order; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(SPELLED_WORD), F.lit(0))


def n_words_of(text: Column) -> Column:
    """How many words a text has; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SPELLED_WORD_AS_IT_IS)).cast("long")


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo mod, equals rest."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == F.lit(rest)
