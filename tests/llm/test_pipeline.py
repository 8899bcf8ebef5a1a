"""The pipeline against its parts, and its stages on odd rows."""
import corpus_pipeline as P
from test_jaccard import kept_by_hand
from voxelflux.llm import plans
from voxelflux.llm.textops import stored, table


def test_pipeline_is_the_chain_of_its_decisions(spark, sf):
    docs = table(spark, sf, "documents")
    start = docs.collect()
    rejected = {r.doc_id for r in plans.op4_language_id(spark, sf).where("rejected").collect()}
    rest = stored(docs.where(~docs.doc_id.isin(list(rejected)))) if rejected else docs
    first = set(kept_by_hand([(r.doc_id, r.text) for r in start if r.doc_id not in rejected]))
    rest = stored(rest.where(rest.doc_id.isin(list(first))))
    leaked = {r.doc_id for r in P.decontaminate.contaminated(rest, table(spark, sf, "benchmark")).collect()}
    want = first - leaked
    got = P.run(spark, sf).collect()
    toxic = {r.doc_id for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    assert {r.doc_id for r in got} <= want and len(got) == len({r.doc_id for r in got})
    assert len(want - {r.doc_id for r in got}) < 0.2 * len(want) and toxic & want - {r.doc_id for r in got}
    text = {r.doc_id: r.text for r in start}
    assert sum(r.text != text[r.doc_id] for r in got) == sum("[SECRET]" in r.text for r in got) > 0
    assert all(r.rate > 0 and 1 <= r.copies and int(r.rate) <= r.copies <= int(r.rate) + 1 for r in got)


def test_stages_on_odd_rows(spark, sf, edge, empty):
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, edge, sf)
        rows = out.collect()
        if k < len(P.STAGES) - 1:
            assert out.columns == edge.columns and out.dtypes == edge.dtypes, name
        assert 0 < len(rows) <= edge.count() and {r.doc_id for r in rows} <= {r.doc_id for r in edge.collect()}
        assert stage(spark, empty, sf).count() == 0
