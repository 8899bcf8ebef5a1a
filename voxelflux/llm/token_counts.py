"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

Documents are counted once (`counted`). A batch of changes becomes signed rows: inserted documents count +1 times, deleted ones -1
times, and a revised count is the old one with -1 and the new one with +1. Only sums of a batch by group are committed, so a ledger grows with
batches and groups and not with documents, and totals are sums of committed rows in any order. A batch is committed under its own name: a
repeated commit changes nothing, and one that was broken off left no success mark and is written anew. `fold` sums committed batches into a base.
"""
import base64

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

KEYS = ("source", "lang", "tokenizer")
MEASURES = ("n_docs", "n_tokens", "n_bytes")
#: Fixed value: the pattern that splits text before the merges of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARIES = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
WORDS = "words"


def counted(docs: DataFrame, vocabularies: dict | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source, lang) and tokenizer version: doc_id, source, lang, tokenizer, n_docs (1), n_tokens, n_bytes.
    Versions are those of `vocabularies` (name: path of a rank file, read by the driver) and `words` (runs between ASCII white space).

    Null text has no token; missing source or lang columns are null; any length of text is read whole; rows that repeat count
    as often as they stand there; other columns are ignored; an empty table gives no row.
    """
    ranks = {}
    for name, path in (VOCABULARIES if vocabularies is None else vocabularies).items():
        with open(path, "rb") as f:
            ranks[name] = f.read()
    ranks = docs.sparkSession.sparkContext.broadcast(ranks)       # about 1 MB for each vocabulary
    names = ["doc_id", "source", "lang", "tokenizer", "n_docs", "n_tokens", "n_bytes"]

    def run(batches):
        coders = {}
        for name, raw in ranks.value.items():
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
            coders[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = [len(t.encode()) for t in texts]
            counts = {name: [len(encode(t)) for t in texts] for name, encode in coders.items()}
            counts[WORDS] = [len(t.encode().split()) for t in texts]
            for name, n in counts.items():
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("lang"), pa.array([name] * len(n), pa.string()),
                                                  pa.array([1] * len(n), pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], names=names)
    col = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), col("source"), col("lang"), col("text"))
    return docs.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long, n_bytes long")


def provisional(counts: DataFrame) -> DataFrame:
    """The counts an ingest can book before it tokenizes: a token for every four bytes."""
    return counts.withColumn("n_tokens", F.ceil(F.col("n_bytes") / 4).cast("long"))


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES])


def deltas(inserted: DataFrame | None = None, deleted: DataFrame | None = None, revised: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Signed sums of a batch by group, from counts (as of `counted`) of inserted and deleted documents and of revised ones (before, after). No join is needed,
    and groups that come to nothing in all measures are left out. A document whose source or language changes is revised like any other."""
    signed = [(inserted, 1), (deleted, -1), *zip(revised or (), (-1, 1))]
    parts = [rows.select(*KEYS, *[(F.col(m) * sign).alias(m) for m in MEASURES]) for rows, sign in signed if rows is not None]
    if not parts:
        raise ValueError("a batch needs inserted, deleted or revised rows")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return summed(out).where(" or ".join(f"{m} != 0" for m in MEASURES))


class Ledger:
    """Committed batches in a folder that all executors share. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _marked(self, folder: str) -> list[str]:
        """Names below a folder whose write succeeded, in order."""
        fs, p = self._fs(f"{self.path}/{folder}")
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1]))

    def batches(self) -> list[str]:
        return self._marked("batches")

    def _base(self) -> tuple[str | None, set[str]]:
        """The latest base and the batches that it holds."""
        bases = [b for b in self._marked("base") if b in self._marked("members")]
        if not bases:
            return None, set()
        return f"{self.path}/base/{bases[-1]}", {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/members/{bases[-1]}").collect()}

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Commit the deltas of a batch; False if it was committed before (nothing is written then)."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"a batch name has letters, digits, - and _: {batch!r}")
        if batch in self.batches():
            return False
        rows.select(*KEYS, *MEASURES).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """Sums of all committed rows; groups without documents are left out."""
        base, members = self._base()
        paths = [f"{self.path}/batches/{b}" for b in self.batches() if b not in members] + ([base] if base else [])
        schema = ", ".join([f"{k} string" for k in KEYS] + [f"{m} long" for m in MEASURES])
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return summed(rows).where("n_docs != 0 or n_tokens != 0")

    def fold(self) -> None:
        """Sum all committed batches into a new base, so that totals read one table. Batch folders stay as marks of what was committed."""
        names, name = self.batches(), f"{len(self._marked('base')):08d}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/base/{name}")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/members/{name}")
