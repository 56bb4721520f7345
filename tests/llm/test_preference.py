"""Preference formatting against plain Python."""
import os
import random

import pytest

from slatemill.llm.preference import conversations, format_pairs, preference_rows

SF = "/root/testdata/sf0.01"


def render(turns):
    text, spans = "", []
    for role, body in turns:
        head = f"<|{role}|>\n"
        if role == "assistant":
            spans.append((len(text) + len(head), len(text) + len(head) + len(body) + len("<|end|>\n")))
        text += head + body + "<|end|>\n"
    return text, spans


def formatted(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) - 1 and chosen[n] == rejected[n]:
        n += 1
    (p, _), (c, cm), (r, rm) = render(chosen[:n]), render(chosen[n:]), render(rejected[n:])
    return n, p, c, r, cm, rm, chosen == rejected


def brute(rows):
    convs = {}
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1], x[2] or "user", x[3] or "")):
        convs.setdefault(c, []).append((r or "user", x or ""))
    by_first, out, alone = {}, {}, []
    for c in sorted(convs):
        by_first.setdefault(convs[c][0], []).append(c)
    for group in by_first.values():
        for a, b in zip(group[::2], group[1::2]):
            out[a] = (b, *formatted(convs[a], convs[b]))
        if len(group) % 2 and any(r == "assistant" for r, _ in convs[group[-1]]):
            alone.append(group[-1])
    alone.sort()
    last = {c: max(i for i, (r, _) in enumerate(convs[c]) if r == "assistant") for c in alone}
    for a, b in zip(alone, alone[1:] + alone[:1]):
        if a != b:
            out[a] = (b, *formatted(convs[a], convs[a][:last[a]] + [convs[b][last[b]]]))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, n int, prompt string").repartition(4)
    got = {}
    for r in preference_rows(df).collect():
        assert r.pair_id == r.chosen_id and r.pair_id not in got
        got[r.pair_id] = (r.rejected_id, r.shared_turns, r.prompt, r.chosen, r.rejected, [tuple(x) for x in r.chosen_mask], [tuple(x) for x in r.rejected_mask], r.same)
    assert got == brute(rows)
    return got


def test_random_conversations(spark):
    rnd, rows = random.Random(9), []
    for c in range(120):
        roles = (["system"] if rnd.random() < 0.3 else []) + ["user", "assistant"] * rnd.randrange(1, 4) + (["user"] if rnd.random() < 0.3 else [])
        rows += [(c * 3, t, r, rnd.choice(["hi", "yes", "nö 𝄞", "", "<|end|>"]) if rnd.random() < 0.8 else None) for t, r in enumerate(roles)]
    rows += [(None, 0, "user", "x"), (1000, None, None, None), (1000, 1, "user", "only"), (1001, 0, "assistant", "long " * 40_000), (5, 0, "user", "dup"), (5, 0, "user", "dup")]
    assert any(g[1] > 1 for g in check(spark, rows).values())


def test_same_and_lonely_conversations(spark):
    rows = [(c, t, r, x) for c in (1, 2, 3, 4, 5) for t, (r, x) in enumerate([("user", "q"), ("assistant", "a")])]
    assert check(spark, rows)[1][-1] is True
    assert check(spark, [(7, 0, "user", "q"), (7, 1, "assistant", "a")]) == {}
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert preference_rows(none).collect() == [] and conversations(none).collect() == []
    odd = spark.createDataFrame([(1, 1, 2, None, [("user", "x")])], "pair_id long, chosen_id long, rejected_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert format_pairs(odd).first().rejected == render([("user", "x")])[0]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_driver_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert len(check(spark, rows)) > 50
