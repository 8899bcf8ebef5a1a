"""Edited copies of benchmark items beside a verbatim copy."""
import random

from voxelflux.llm import decontaminate
from test_dedup import align_by_hand


def test_edited_copies_beside_a_verbatim_one(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randint(3, 7)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((4, 5, 8, 15, 30, 40, 59))]
    rows = []
    for _, t in items:
        w = t.split()
        copies = [w] + [[x if j % k else word() for j, x in enumerate(w)] for k in (4, 5, 6)] + [[y for j, x in enumerate(w) for y in ([x, word()] if j % 2 else [x])]]
        copies += [[y for x in w for y in (x, word())]] + [[x if rnd.random() > 0.22 else word() for x in w] for _ in range(4)]
        rows += [" ".join([word() for _ in range(60)] + c + [word() for _ in range(60)]) for c in copies]
    rows = list(enumerate(rows))
    want = {(d, i) for d, t in rows for i, x in items if align_by_hand(x.split(), t.split()) >= 0.6 * 2 * len(x.split())}
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 45
