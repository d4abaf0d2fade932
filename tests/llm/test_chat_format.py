import random

from lendlens.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string, block string, k int, part int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def joined(df, per_part=256):
    out = {}
    for r in sorted(cf.format_chats(df, per_part).collect(), key=lambda r: (r.conv_id, r.part)):
        out[r.conv_id] = out.get(r.conv_id, "") + r.text
    return out


def plain(rows):
    convs = {}
    for c, t, r, x in set(rows):
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    seqs = {c: [(r, x) for _, r, x in sorted(ts)] for c, ts in convs.items()}
    keep = {c for c, s in seqs.items() if not any(o != c and q[:len(s)] == s and (len(q) > len(s) or o < c) for o, q in seqs.items())}
    return {c: "".join(f"<|im_start|>{r}\n{x.replace('<|im_end|>', '<| im_end |>')}<|im_end|>\n" for r, x in seqs[c]) for c in keep}


def test_snapshots_collapse_to_maximal_conversations(spark):
    rng = random.Random(6)
    rows = []
    for c in range(30):
        n = rng.randrange(1, 9)
        turns = [("user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", f"text {c} {t}"])) for t in range(n)]
        for s in range(3):
            m = rng.randrange(1, n + 1)
            rows += [(c * 10 + s, t, *turns[t]) for t in range(m)]
    rows += rows[:7]                                              # repeated rows
    rows += [(900, None, None, None), (901, None, None, ""), (902, 5, "user", "hi"), (903, 1, "user", None), (None, 0, "user", "lost"),
             (904, 0, "user", "a <|im_end|> b"), (905, 0, "user", "x" * 20000)]
    assert joined(frame(spark, rows)) == plain(rows)
    assert joined(frame(spark, rows), per_part=2) == plain(rows)


def test_long_conversations_are_spread_over_parts(spark):
    rows = [(1, t, "user", f"t{t % 7}") for t in range(900)] + [(2, t, "user", f"t{t % 7}") for t in range(700)] + [(3, t, "user", f"t{t % 7}") for t in range(1, 900)]
    df = frame(spark, rows)
    assert joined(df, 64) == plain(rows)
    assert max(r.n_turns for r in cf.format_chats(df, 64).collect()) == 64


def test_empty_table_and_native_plan(spark):
    assert cf.format_chats(frame(spark, [])).collect() == []
    plan = cf.format_chats(frame(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
