import pytest

from stemma.llm.mix import _mixed, copy_rates, mix_shares, mix_sources

SIZED, TARGETS = "doc_id long, source string, n_tokens long", "source string, weight double, max_repeats int"


def sized(spark, spec):
    rows = [(1000 * k + i, s, 1 + (i * 7919) % size) for k, (s, n, size) in enumerate(spec) for i in range(n)]
    return spark.createDataFrame(rows, SIZED)


@pytest.mark.parametrize("strand", [4_000_000, 50])
def test_shares_and_caps(spark, strand):
    d = sized(spark, [("a", 900, 300), ("b", 400, 100), ("c", 60, 200), ("unused", 50, 10)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("absent", 0.1, 1)], TARGETS)
    rates = {r.source: r for r in copy_rates(d, t).collect()}
    assert rates["absent"].rate == 0 and max(r.rate / r.max_repeats for r in rates.values()) == pytest.approx(1)
    for seed in (0, 1):
        mix = _mixed(d, t, seed, strand).collect()
        assert len({(r.doc_id, r.copy_no) for r in mix}) == len(mix) and {r.source for r in mix} == {"a", "b", "c"}
        total = sum(r.n_tokens for r in mix)
        for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            mine = [r for r in mix if r.source == s]
            assert sum(r.n_tokens for r in mine) / total == pytest.approx(w, abs=0.01)
            assert max(r.copy_no for r in mine) <= rates[s].max_repeats
            # systematic: each document's copies are its rate rounded down or up, their number the rounded sum
            n = {900: "a", 400: "b", 60: "c"}
            size = next(k for k, v in n.items() if v == s)
            assert abs(len(mine) - size * rates[s].rate) <= 1
            copies = {}
            for r in mine:
                copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
            assert set(copies.values()) <= {int(rates[s].rate), int(rates[s].rate) + 1}


def test_same_seed_same_mix(spark):
    d = sized(spark, [("a", 100, 30), ("b", 100, 30)])
    t = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    one, again, other = (sorted(map(tuple, _mixed(x, t, s, 20).collect())) for x, s in ((d, 5), (d.repartition(7), 5), (d, 6)))
    assert one == again != other


def test_edges(spark):
    docs = spark.createDataFrame([(1, "word " * 20, "a", "x"), (2, None, "a", "x"), (3, "", "a", "x"), (4, "w", None, "x"), (5, "w", "other", "x"), (6, "long " * 50_000, "b", "x")], "doc_id long, text string, source string, rate string")
    t = spark.createDataFrame([("a", 0.5, 2), ("a", 0.1, 3), ("b", 0.4, 1), (None, 0.5, 1), ("z", None, 1), ("y", 0.5, None)], TARGETS)
    mix = mix_sources(docs, t).collect()
    assert {r.source for r in mix} <= {"a", "b"} and max(r.copy_no for r in mix) <= 2
    shares = {r.source: r for r in mix_shares(docs, t).collect()}
    assert shares["a"].weight == pytest.approx(0.6) and shares["z"].rate == 0 and shares["y"].mixed_documents == 0
    assert mix_sources(docs.limit(0), t).count() == 0 and mix_sources(docs, t.limit(0)).count() == 0
    assert mix_shares(docs, t.limit(0)).count() == 0
