"""Registered queries of the subpackage: each applies one operator, with production parameters, to its whole table."""
from pyspark.sql import functions as F

from . import chat, collocations, factorisation, fim, language, token_counts
from .decontaminate import contaminated
from .mixing import mixed
from .quality_rules import QUALITY_SQL, cascade
from .secrets import secrets
from .simhash import near_duplicates
from .substrings import repeated_bytes
from .textops import held_out, shared_folder, stored, table
from .units import RUNS_SQL, repeated_runs

QUERIES, ORACLES = {}, {}


def query(name, oracle=None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    return repeated_bytes(table(spark, sf_dir, "documents"), length=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op3_simhash")
def op3_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), bits=3, shingle=3)


@query("op6_quality_cascade", QUALITY_SQL)
def op6_quality_cascade(spark, sf_dir):
    return cascade(table(spark, sf_dir, "documents")).drop("rules_run")


@query("op7_secret_scan")
def op7_secret_scan(spark, sf_dir):
    return secrets(table(spark, sf_dir, "documents"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs.where(~held_out("doc_id")), per_class=500))


@query("op8_quality_classifier")
def op8_quality_classifier(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return factorisation.score(docs, factorisation.fit(docs, labels.where(~held_out("doc_id")), per_class=1500), cut=0.7)


@query("op9_line_dedup", RUNS_SQL)
def op9_line_dedup(spark, sf_dir):
    return repeated_runs(table(spark, sf_dir, "documents"), min_words=25).drop("h")


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.6).drop("h")


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """A ledger with four batches: documents come in with provisional counts, exact counts revise them (committed twice, as after a lost
    reply), the documents of one residue of doc_id are withdrawn, and come in again. The totals are those of the whole table."""
    counts = stored(token_counts.counted(table(spark, sf_dir, "documents")))
    ledger = token_counts.Ledger(spark, shared_folder(spark))
    early, some = token_counts.provisional(counts), counts.where("doc_id % 10 = 3")
    ledger.commit("ingest", token_counts.deltas(inserted=early))
    for _ in range(2):
        ledger.commit("exact-counts", token_counts.deltas(revised=(early, counts)))
    ledger.commit("withdrawn", token_counts.deltas(deleted=some))
    ledger.commit("back", token_counts.deltas(inserted=some))
    return ledger.totals()


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_fim", fim.FIM_SQL)
def op11_fim(spark, sf_dir):
    out = fim.transformed(table(spark, sf_dir, "documents"), rate=90, spm=20)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored("output", "form"), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op12_chat", chat.CHAT_SQL)
def op12_chat(spark, sf_dir):
    """The table's rows come as an event log with streamed, regenerated, edited and repeated messages; conversation -7 holds the template's own marks."""
    marks = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(stored(chat.formatted(chat.log_of(turns.unionByName(own)))))


@query("op13_collocations", collocations.PHRASES_SQL)
def op13_collocations(spark, sf_dir):
    return collocations.phrases(table(spark, sf_dir, "documents"), least=100, top=2000)
