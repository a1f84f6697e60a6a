import random

from pyspark.sql import functions as F

from vertexlens.llm.chat import echoed, preference_pairs
from vertexlens.llm.packing import PackParams, pack, packed, pieces, word_lengths


def test_nothing_is_lost_or_overfull(spark):
    r = random.Random(3)
    sizes = [(i, r.choice([r.randrange(1, 300), r.randrange(1, 5000), 0])) for i in range(900)] + [(5000, 20_001), (5001, None), (5002, -4), (None, 7), (3, 100), (3, 100)]
    p = PackParams(shard_rows=200)
    rows = packed(spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint"), p).collect()
    total = {}
    for x in rows:
        total[x.doc_id] = total.get(x.doc_id, 0) + x.n_tokens
    want = {}
    for d, n in sizes:
        want[d] = want.get(d, 0) + max(n or 0, 0)
    assert total == want
    bins = {}
    for x in rows:
        if x.n_tokens:
            bins.setdefault((x.shard, x.bin), []).append(x)
        else:
            assert x.bin is None and x.bin_length is None
    for own in bins.values():
        own.sort(key=lambda x: x.bin_offset)
        at = 0
        for x in own:
            assert x.bin_offset == at
            at += x.n_tokens
        assert {x.bin_length for x in own} == {min(n for n in p.lengths if n >= at)}
    again = packed(spark.createDataFrame(sizes[::-1], "doc_id bigint, n_tokens bigint").repartition(7), p).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_best_fit_is_brute_force_best_fit():
    r = random.Random(6)
    p = PackParams(lengths=(8, 16, 32))
    for _ in range(50):
        sizes = sorted((r.randrange(1, 33) for _ in range(40)), reverse=True)
        place, _, final = pack(sizes, p)
        free, cap = [], []
        for s, b in zip(sizes, place):
            fits = [(f, k) for k, f in enumerate(free) if f >= s]
            if fits:
                assert free[b] == min(fits)[0]
            else:
                n = min((n for n in p.lengths if n >= s), key=lambda n: p.cost(n) * (1 - p.discount * (n - s) / n))
                free.append(n)
                cap.append(n)
                assert b == len(free) - 1
            free[b] -= s
        assert final == [min(n for n in p.lengths if n >= c - f) for c, f in zip(cap, free)]


def test_several_lengths_cost_less_than_one():
    r = random.Random(7)
    sizes = sorted((min(8192, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(2000)), reverse=True)
    p = PackParams()
    many = sum(map(p.cost, pack(sizes, p)[2]))
    one = len(pack(sizes, PackParams(lengths=(8192,)))[2]) * p.cost(8192)
    assert many < one and sum(pack(sizes, p)[2]) < 1.05 * sum(sizes)


def test_pieces_and_lengths(docs_of):
    assert pieces(20, 8) == [8, 8, 4] and pieces(16, 8) == [8, 8] and pieces(0, 8) == []
    got = {r.doc_id: r.n_tokens for r in word_lengths(docs_of([(1, "a b\tc"), (2, None), (3, " \n"), (4, "é")])).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 2}


def render(turns):
    return "".join(f"<|{role}|>\n{text}\n" for role, text in turns)


def test_pairs(spark):
    chosen = [("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "good")]
    rejected = [("user", "hi"), ("assistant", "yes"), ("user", "less")]
    rows = [(1, "chosen", i, *t) for i, t in enumerate(chosen)] + [(1, "rejected", 10 * i, *t) for i, t in enumerate(rejected)]
    rows += [(2, "chosen", 0, "user", "only"), (3, "chosen", 0, "user", "x"), (3, "rejected", 0, "user", "x"), (4, "chosen", 0, None, None), (4, "rejected", 0, "assistant", "")]
    rows += [(None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x")]
    got = {r.pair_id: r for r in preference_pairs(spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    a = got[1]
    assert a.n_common == 2 and a.prompt == render(chosen[:2]) and a.chosen == render(chosen[2:]) and a.rejected == render(rejected[2:])
    spans = [tuple(map(int, x.split(":"))) for x in a.chosen_mask.split(",")]
    assert sum(map(sum, spans)) == len(a.chosen) and spans[0][1] == 0
    masked, trained = spans[1]
    assert a.chosen[len(a.chosen) - trained :] == "good\n" and a.rejected_mask == f"{len(a.rejected)}:0"
    assert got[2].n_common == 0 and got[2].chosen == render([("user", "only")]) and got[2].rejected == "" == got[2].rejected_mask
    assert got[3].prompt == render([("user", "x")]) and got[3].chosen == got[3].rejected == ""
    assert got[4].n_common == 0 and got[4].chosen == render([("", "")])


def test_empty_pairs(spark):
    assert preference_pairs(spark.createDataFrame([], "pair_id bigint, side string, turn bigint, role string, text string, s string")).count() == 0


def test_a_rejected_conversation_shares_all_but_its_answer(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "more"), (1, 3, "assistant", "good"), (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (4, 5, "user", "a"), (4, 5, "assistant", None)]
    turns = spark.createDataFrame(rows, "pair_id bigint, turn bigint, role string, text string").repartition("pair_id")
    got = {r.pair_id: r for r in preference_pairs(echoed(turns), dealt=True).collect()}
    assert got[1].n_common == 3 and got[1].prompt == render([("user", "hi"), ("assistant", "yes"), ("user", "more")])
    assert got[1].chosen == render([("assistant", "good")]) and got[1].rejected == render([("assistant", "more")])
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == "" and got[3].chosen == render([("assistant", "first")]) and got[3].rejected == render([("assistant", "")])
    assert got[4].n_common == 2 and got[4].prompt == render([("assistant", ""), ("user", "a")]) and got[4].rejected == got[4].chosen == ""


def test_long_conversations_and_equal_turn_numbers(spark):
    turns = [(7, side, i // 3, "user" if i % 2 else "assistant", f"t{i:05d}" + "x" * (50_000 if i == 9 else 0)) for side in ("chosen", "rejected") for i in range(3000)]
    turns[-1] = (7, "rejected", 999, "user", "z")
    df = spark.createDataFrame(turns, "pair_id bigint, side string, turn bigint, role string, text string").repartition(5)
    (got,) = preference_pairs(df.withColumn("place", F.lit(1)).withColumn("same", F.lit(2))).collect()
    ordered = sorted((t[2:] for t in turns[:3000]), key=lambda t: (t[0], t[1], t[2]))
    assert got.n_common == 2999 and got.prompt == render([t[1:] for t in ordered[:-1]]) and got.rejected == render([("user", "z")])


def test_a_hot_row_is_dealt_over_all_shards(spark):
    rows = [(None, 100)] * 9000 + [(i, 50 + i % 90) for i in range(3000)]
    p = PackParams(shard_rows=1000)
    got = packed(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("shard", F.lit("x")).withColumn("c", F.lit("y")), p).collect()
    hot = {}
    for r in got:
        hot[r.shard] = hot.get(r.shard, 0) + (r.doc_id is None)
    assert len(got) == 12000 and len(hot) == 12 and set(hot.values()) == {750}
    assert packed(spark.createDataFrame([], "doc_id bigint, n_tokens bigint")).count() == 0
