from tidewheel.llm import preferences as P


def slow(chosen, rejected):
    def turns(rows):
        out = {}
        for r in sorted(rows, key=lambda r: (r.turn is None, r.turn or 0, r.role or "", r.text or "")):
            out.setdefault(r.pair_id, []).append((r.role or "", r.text or ""))
        return out

    def render(turns):
        text, mask = "", []
        for role, said in turns:
            text += f"<|{role}|>\n"
            start = len(text)
            text += said + "<|end|>\n"
            if role == "assistant":
                mask.append((start, len(text)))
        return text, mask

    a, b = turns(chosen), turns(rejected)
    out = []
    for key in a.keys() | b.keys():
        x, y, n = a.get(key, []), b.get(key, []), 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        (c, cm), (r, rm) = render(x[n:]), render(y[n:])
        out.append((str(key), n, render(x[:n])[0], c, r, cm, rm))
    return sorted(out)


def got(rows):
    return sorted((str(r.pair_id), r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask]) for r in rows)


def test_odd_pairs(spark):
    schema = "pair_id long, turn int, role string, text string, a string, n int, turns string"
    x = [(1, 0, "user", "hi"), (1, 1, "assistant", "é日"), (1, 2, "user", "more"), (2, 0, "user", "q"), (3, 0, None, None), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (None, 0, "user", "z"), (4, None, "assistant", "late"), (4, 5, "user", "early"), (6, 0, "assistant", "x" * 40000)]
    y = [(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q"), (2, 1, "assistant", ""), (3, 0, "", ""), (3, 1, "assistant", "a"), (None, 0, "user", "z"), (5, 0, "assistant", "only rejected"), (6, 0, "assistant", "x" * 40001)]
    a, b = (spark.createDataFrame([(*r, "c", 1, "d") for r in rows], schema) for rows in (x, y))
    assert got(P.format_pairs(a, b).collect()) == slow(a.collect(), b.collect())
    assert P.format_pairs(a.limit(0), b.limit(0)).collect() == []


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    chosen, rejected = P.stale_replies(turns)
    want = slow(chosen.collect(), rejected.collect())
    assert got(P.format_pairs(chosen, rejected).collect()) == want
    one = sorted((str(r.conv_id), r.n_prompt_turns, r.prompt, r.chosen, r.rejected) for r in P.op6_preference_pairs(spark, "/root/testdata/sf0.01").collect())
    assert one == [w[:5] for w in want]
    assert len(want) == turns.where("role = 'assistant'").select("conv_id").distinct().count() and any(w[2] for w in want)


def test_turns_without_a_number_make_no_pair(spark):
    rows = [(1, None, "user", "a"), (1, None, "assistant", "b"), (2, 1, "user", "c"), (2, 2, "assistant", "d"), (2, None, "assistant", "e")]
    sides = P.stale_replies(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    assert [sorted((r.pair_id, r.turn) for r in side.collect()) for side in sides] == [[(2, 1), (2, 2)]] * 2
