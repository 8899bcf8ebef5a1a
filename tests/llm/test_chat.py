"""Event-sourced chat formatting: folds by hand, escapes both ways, long conversations in parts."""
import collections
import hashlib
import random

from pyspark.sql import functions as F

from voxelflux.llm import chat


def final_by_hand(events):
    """Messages of one conversation after its events, by turn and message."""
    state, seen = {}, collections.defaultdict(set)
    for turn, message, seq, kind, role, text in sorted((e for e in events if e[2] is not None), key=lambda e: e[2]):
        key = (turn, message)
        if seq in seen[key]:
            continue
        seen[key].add(seq)
        old = state.get(key)
        if kind == "open":
            state[key] = (role or "", old[1] if old else "")
        elif kind == "delete":
            state.pop(key, None)
        elif old and kind in ("delta", "edit", "regenerate"):
            state[key] = (old[0], {"delta": old[1] + (text or ""), "edit": text or "", "regenerate": ""}[kind])
    return [state[k] for k in sorted(state, key=lambda k: tuple((x is not None, x or 0) for x in k))]


def row_by_hand(conv, messages):
    learnt = "".join(t for r, t in messages if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return conv, len(messages), sha("".join(f"{r}\n{t}\n" for r, t in messages)), len(learnt), sha(learnt)


def test_escapes_both_ways():
    rnd = random.Random(1)
    bits = ["\\", "###", "#", "</turn>", "</turn", "\n", ": ", ":", " ", "a", "é", "### ", "</turn>\n", "<"]
    for _ in range(500):
        said = [("".join(rnd.choice(bits) for _ in range(rnd.randint(0, 4))), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))) for _ in range(rnd.randint(0, 4))]
        said += [("assistant", "".join(rnd.choice(bits) for _ in range(6)))]
        text, spans = chat.rendered(said)
        assert list(chat.parsed(text)) == said
        assert "".join(chat.unescaped(text[s["begin"]:s["finish"]]) for s in spans) == "".join(t for r, t in said if r == "assistant")


def test_logs_fold_like_by_hand(spark):
    rnd = random.Random(2)
    log = []
    for conv in (*range(40), None, -7):
        for seq in range(rnd.randint(1, 60)):
            kind = rnd.choice(["open", "open", "delta", "delta", "delta", "edit", "regenerate", "delete", "unknown", None])
            turn = rnd.choice([0, 1, 2, 255, 256, 700, None, -1])
            e = (conv, turn, rnd.choice([None, 5]), rnd.choice([seq] * 9 + [None]), kind, rnd.choice(["user", "assistant", None]), rnd.choice(["text", "### </turn>", "\\", "", None]))
            log += [e] * rnd.choice([1, 1, 1, 2])
    rnd.shuffle(log)
    df = spark.createDataFrame(log, chat.EVENT).withColumn("part", F.lit("clash"))
    got = {tuple(r)[:5] for r in chat.read_back(chat.formatted(df)).collect()}
    by = collections.defaultdict(list)
    for conv, *e in log:
        by[conv].append(e)
    want = {row_by_hand(conv, m) for conv, events in by.items() if (m := final_by_hand(events))}
    assert got == want and len(got) > 30
    assert chat.formatted(df.limit(0)).collect() == [] and chat.read_back(chat.formatted(df.limit(0))).collect() == []


def test_formats_rows_of_turns(spark):
    rnd = random.Random(3)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), rnd.choice(["", "one ### two", "long " * 500, "\\### Assistant: </turn> ok", "é\n" * 90])) for c in range(30) for t in range(rnd.randint(1, 6))]
    rows += [(90, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(2000)]                # eight parts
    rows += [(91, 0, None, None), (91, 1, "assistant", None), (None, 0, "user", "no id"), (92, None, "user", "no turn"), (92, 0, "assistant", "first " * 30_000)]
    rows += [(93, 0, "user", "same")] * 3
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("seq", "part", "message", "kind", "times", "copy")})
    parts = chat.formatted(chat.log_of(df))
    assert parts.where("conv_id = 90").count() == 8 and parts.agg(F.max("n_turns")).first()[0] == 256
    got = {tuple(r)[:5] for r in chat.read_back(parts).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        by[c].append((r or "", x or ""))
    assert got == {row_by_hand(c, m) for c, m in by.items()}
    assert chat.formatted(chat.log_of(df.limit(0))).collect() == []
    kinds = {r.kind for r in chat.log_of(df).select("kind").distinct().collect()}
    assert kinds == {"open", "delta", "edit", "regenerate", "delete"}
