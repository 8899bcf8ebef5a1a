"""Shared helpers: reading tables, tables in the shared folder, Arrow batches as byte chunks, vectorised word hashes."""
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII white-space characters of the word rule [^\x20\x09-\x0D]+.
SPACES = b" \t\n\x0b\x0c\r"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session (tests) gets a local
    folder as checkpoint folder, and a cluster session an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` once into the shared folder and read it back: cuts lineage and survives lost executors. Shuffle files of
    finished writes go when the driver collects its garbage; that is asked for here, so disks don't fill up with them."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Delete tables made by `stored` that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a bitmap of hashes.
BITS = 1 << 25


def bitmap(grams: DataFrame) -> np.ndarray:
    """BITS bits with two set for each hash in column g; what comes to the driver has this fixed size at most."""
    place = F.explode(F.array(F.col("g").bitwiseAND(BITS - 1), F.shiftrightunsigned("g", 32).bitwiseAND(BITS - 1)))
    rows = grams.select(place.alias("p")).groupBy(F.shiftright("p", 5).alias("slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("bits")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[rows["slot"].to_numpy().astype(np.int64)] = rows["bits"].to_numpy().astype(np.uint32)
    return out


def passes(g: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which hashes have both bits set."""
    def bit(h, shift):
        at = (h >> U64(shift)) & U64(BITS - 1)
        return (table[(at >> U64(5)).astype(np.int64)] >> (at & U64(31)).astype(np.uint32)) & 1 == 1
    ok = bit(g, 0)
    some = np.flatnonzero(ok)
    ok[some] = bit(g[some], 32)
    return ok


def held_out(doc_id) -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id counts as not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary Arrow column and its n+1 offsets (int64); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:                       # a null slot may span bytes; give it none
        size = np.where(np.asarray(column.is_null()), 0, np.diff(offs))
        if (size != np.diff(offs)).any():
            data = np.concatenate([data[a:a + s] for a, s in zip(offs[:-1], size)] or [data[:0]])
            offs = np.concatenate([[0], np.cumsum(size)])
    return data, offs


def chunks(column: pa.Array, limit: int = 1 << 17):
    """Runs of rows of about `limit` bytes, at least one row each: (first row, row after the last, bytes, offsets from 0)."""
    data, offs = byte_view(column)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: One 64-bit number for each byte value, made by a rule.
BYTE_CODE = scramble(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE = U64(0x5851F42D4C957F2D)


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), BASE, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a chunk: start and end byte, row, and a 64-bit hash of each. `fold` maps a byte to the byte compared, 0 for
    bytes between words. Words never cross rows."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: np.ndarray):
        code = fold[data] if len(data) else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = code != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offs] = True                                        # a row's end also ends a word
        start = inside[1:] & (~inside[:-1] | edge)
        end = inside[:-1] & (~inside[1:] | edge)
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end)
        self.row = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs[:-1])      # words of row r: first[r] .. last[r]
        self.last = np.searchsorted(self.start, offs[1:])
        if len(self.start):
            size = self.end - self.start
            at = np.arange(len(data), dtype=np.int64)
            word = np.repeat(np.arange(len(size)), size)
            pick = code[inside[1:-1]]
            term = BYTE_CODE[pick] * powers(int(size.max()))[at[inside[1:-1]] - self.start[word]]
            self.hash = scramble(np.add.reduceat(term, np.cumsum(size) - size) + size.astype(U64))
        else:
            self.hash = np.zeros(0, U64)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of each run of n words inside a row, and the hash of the run."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        m = len(self.hash) - n + 1
        h = np.zeros(m, U64)
        for k in range(n):
            h = h * U64(0x9E3779B97F4A7C15) + self.hash[k:k + m]
        at = np.flatnonzero(self.row[:m] == self.row[n - 1:])
        return at, scramble(h[at])


def lowered(keep) -> np.ndarray:
    """Fold table: A-Z to a-z, bytes not in `keep` to 0. Bytes of non-ASCII letters are always kept."""
    fold = np.zeros(256, np.uint8)
    for b in range(256):
        c = b + 32 if 65 <= b <= 90 else b
        if b >= 128 or keep(c):
            fold[b] = c
    return fold


#: Words are runs of letters, digits and non-ASCII bytes.
ALNUM = lowered(lambda c: chr(c).isalnum())
#: Words are runs of letters and non-ASCII bytes.
LETTERS = lowered(lambda c: chr(c).isalpha())
#: Words are runs of anything but the six white-space characters.
NONSPACE = lowered(lambda c: c not in SPACES and c != 0)


def taken(batch: pa.RecordBatch, name: str, rows: np.ndarray) -> pa.Array:
    return batch.column(name).take(pa.array(rows))
