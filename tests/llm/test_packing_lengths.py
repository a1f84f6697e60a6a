import random

from vertexlens.llm.packing import PackParams, cheapest, look_ahead, pack, packed


def smallest(n, p):
    return next(m for m in p.lengths if m >= n)


def cost(packing, p):
    return sum(map(p.cost, packing[2]))


def test_equal_lengths_cost_less_than_smallest_fits(spark):
    p = PackParams()
    assert cost(cheapest([300] * 50, p), p) < 0.7 * cost(pack([300] * 50, p), p)
    rows = packed(spark.createDataFrame([(i, 300) for i in range(50)], "doc_id bigint, n_tokens bigint"), p).collect()
    bins = {r.bin: r.bin_length for r in rows}
    assert sorted(r.doc_id for r in rows) == list(range(50)) and sum(map(p.cost, bins.values())) < 0.7 * 50 * p.cost(512)


def test_some_bins_open_larger_and_some_are_downsized():
    r = random.Random(1)
    p = PackParams()
    larger = downsized = cheaper = 0
    for _ in range(100):
        sizes = sorted((r.choice([r.randrange(250, 400), r.randrange(500, 900), r.randrange(250, 3000)]) for _ in range(60)), reverse=True)
        choose, opened = look_ahead(sizes, p), []
        ahead = pack(sizes, p, lambda i: opened.append((sizes[i], choose(i))) or opened[-1][1])
        larger += sum(n > smallest(s, p) for s, n in opened)
        downsized += sum(final < n for (_, n), final in zip(opened, ahead[2]))
        cheaper += cost(ahead, p) < cost(pack(sizes, p), p)
        assert cost(cheapest(sizes, p), p) == min(cost(ahead, p), cost(pack(sizes, p), p))
        for packing in (ahead, cheapest(sizes, p)):
            used = [0] * len(packing[2])
            for s, b, at in zip(sizes, *packing[:2]):
                assert at == used[b]
                used[b] += s
            assert packing[2] == [smallest(u, p) for u in used]
    assert larger and downsized and cheaper > 80
