"""Fill-in-middle transformation as a pipeline of Arrow compute functions.

Texts are split into units (runs of letters A-Z, a-z, or one other character) as list arrays; the lists are flattened with the rows they come from, units get
their ordinals, are filtered by role (prefix, middle, suffix), and are joined again per batch. No step runs per row or per unit in Python.
"""
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .textops import chunks

#: One unit in UTF-8 bytes: a run of letters, or a first byte of another character with the bytes that follow it.
UNIT = rb"[A-Za-z]+|[^A-Za-z\x80-\xBF][\x80-\xBF]*"
#: A byte that UTF-8 never uses ends each unit while texts are split.
END = b"\xff"
SENTINELS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def units(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of each text as a list array (each list ends with an empty unit) and how many there are."""
    lists = pc.split_pattern(pc.replace_substring_regex(text, UNIT, rb"\0" + END), END)
    return lists, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) - 1


def pieces(lists: pa.Array, n: np.ndarray, first: np.ndarray, second: np.ndarray) -> dict[str, pa.Array]:
    """Texts of the units before `first`, from there to `second`, and after it, in each list."""
    parent, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pa.array(np.append(0, np.cumsum(n + 1))[:-1]), parent))
    early, late = (pc.less(ordinal, pc.take(pa.array(cut), parent)) for cut in (first, second))
    out = {}
    for name, role, size in (("prefix", early, first), ("middle", pc.and_not(late, early), second - first), ("suffix", pc.invert(late), n + 1 - second)):
        picked = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(size))), pc.filter(flat, role))
        out[name] = pc.binary_join(picked, pa.scalar(b"", pa.large_binary()))
    return out


def _forms(rate: int, spm: int):
    def run(batches):
        for batch in batches:
            h = [batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            for i, j, _, _ in chunks(batch.column("text"), 1 << 20):
                text = pc.fill_null(batch.column("text").slice(i, j - i).cast(pa.large_binary()), b"")
                lists, n = units(text)
                x, y, third, fourth = (v[i:j] for v in h)
                cut = np.sort(np.stack([x % (n + 1), y % (n + 1)]), axis=0)
                part = pieces(lists, n, *cut)
                marked = pc.match_substring_regex(text, b"<[PSM]>")
                plain = pc.or_(pc.or_(marked, pa.array(n == 0)), pa.array(third % 100 >= rate))
                spm_rows = pa.array(fourth % 100 < spm)
                ordered = {form: pc.binary_join_element_wise(*[pa.scalar(v, pa.large_binary()) if isinstance(v, bytes) else v for name in names
                                                               for v in (SENTINELS[name].encode(), part[name])], pa.scalar(b"", pa.large_binary()))
                           for form, names in ORDERS.items()}
                output = pc.if_else(plain, text, pc.if_else(spm_rows, ordered["spm"], ordered["psm"]))
                form = pc.if_else(plain, "plain", pc.if_else(spm_rows, "spm", "psm"))
                size = lambda name: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part[name].cast(pa.large_string())))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n), form, size("prefix"), size("middle"), output.cast(pa.large_string()).cast(pa.string())],
                                                 names=[c.split()[0] for c in SCHEMA.split(", ")])
    return run


def draws(doc_id: Column) -> list[Column]:
    """The first four groups of eight hex digits of the SHA-256 of `1:` and the decimal id, as unsigned numbers."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transformed(docs: DataFrame, rate: int = 90, spm: int = 20) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, n (units), form (`plain`, `psm`, `spm`), prefix_chars, middle_chars (code points; null if
    plain), output. `rate` of 100 documents are transformed, `spm` of 100 of them with the suffix first; cuts and forms are drawn from doc_id alone.

    The prefix ends after the smaller of two drawn numbers of units, the middle after the larger. Null and empty texts, and texts with a sentinel in
    them, stay plain; a null doc_id is drawn as an empty one; rows with one doc_id are cut by the same draws; texts are read whole, of any length; other columns are
    ignored; an empty table gives no row.
    """
    key = F.col("doc_id").cast("long")
    source = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"), *draws(key))
    return source.mapInArrow(_forms(rate, spm), SCHEMA)


def restored(output, form) -> Column:
    """The original text from an output and its form. Sentinels mark the parts, as no part holds one."""
    output, form = F.col(output), F.col(form)
    halves = F.split(F.substr(output, F.lit(4)), SENTINELS["middle"], 2)
    psm, spm = (F.split(halves[0], SENTINELS[ORDERS[k][1]], 2) for k in ("psm", "spm"))
    return F.when(form == "psm", F.concat(psm[0], halves[1], psm[1])).when(form == "spm", F.concat(spm[1], halves[1], spm[0])).otherwise(output)


#: DuckDB text of the query's rows.
FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]', 0, 's') AS w, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:], '') AS suf,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form != 'plain' THEN length(pre) END AS BIGINT) AS prefix_chars,
       CAST(CASE WHEN form != 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
