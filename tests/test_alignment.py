import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.operators import alignment as al
from loomtext.params import PhoneticParams, ReuseParams

P = ReuseParams()
SHORT = st.text(alphabet="abcd", max_size=40)


@given(SHORT, SHORT)
@settings(max_examples=300, deadline=None)
def test_seeds_are_the_longest_matches(d, s):
    want = []
    for i in range(len(d) - 2):
        best = None
        for j in range(len(s)):
            n = 0
            while i + n < len(d) and j + n < len(s) and d[i + n] == s[j + n]:
                n += 1
            if n >= 3 and (best is None or n > best[2]):
                best = (i, j, n)
        if best:
            want.append(best)
    assert al.find_seeds(d, s, 3) == want


@given(SHORT, SHORT)
@settings(max_examples=300, deadline=None)
def test_segments_tile_the_digest(d, s):
    spans = al.align(d, s, P)
    assert [x.d_start for x in spans] == [0, *[x.d_end for x in spans]][: len(spans)]
    assert not d or spans[-1].d_end == len(d)
    for x in spans:
        assert (x.kind == "novel") == (x.s_start < 0)
        if x.kind == "exact":
            assert d[x.d_start : x.d_end] == s[x.s_start : x.s_end]


def test_touching_seeds_of_a_diagonal_merge_in_the_order_they_were_met():
    assert al.merge_diagonals([(0, 10, 5), (1, 3, 5), (5, 15, 5), (20, 30, 5)]) == [(0, 10, 10), (20, 30, 5), (1, 3, 5)]


@pytest.mark.parametrize(
    ("a", "b", "reach"),
    [("abcdef", "abcdef", (6, 6)), ("", "abc", (0, 0)), ("abXcdefg", "abcdefg", (8, 7)), ("abcdefg", "abXcdefg", (7, 8)), ("xyz", "abc", (0, 0)), ("abcdXfghij", "abcdYfghij", (10, 10)), ("a", "a", (1, 1))],
)
def test_extension(a, b, reach):
    assert al.stretch(a, b, P) == reach


def spans(*bounds):
    return [al.Span(a, b, a, b, "exact") for a, b in bounds]


def total(chosen):
    return sum(x.d_end - x.d_start for x in chosen)


def test_chaining_continues_the_last_earlier_span_unless_asked_for_the_best():
    x = spans((0, 20), (16, 22), (22, 30))
    assert total(al.chain(x)) == 20 and total(al.chain(x, optimal=True)) == 28
    assert al.chain([]) == [] and total(al.chain(spans((0, 10), (2, 5)))) == 10


@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 15)), max_size=9))
@settings(max_examples=300, deadline=None)
def test_optimal_chains_are_best(items):
    x = spans(*((a, a + n) for a, n in items))
    chosen = al.chain(x, optimal=True)
    assert all(p.d_end <= q.d_start for p, q in zip(chosen, chosen[1:]))
    best = 0
    for mask in range(1 << len(x)):
        own = sorted(x[i] for i in range(len(x)) if mask >> i & 1)
        if all(p.d_end <= q.d_start for p, q in zip(own, own[1:])):
            best = max(best, total(own))
    assert total(chosen) == best >= total(al.chain(x))


def test_phonetic_rescan():
    table = {c: frozenset([s]) for c, s in zip("abcdeABCDE", "12345" * 2)}
    got = al.align("zzzzzabcdezzzz", "yyABCDEyyyy", P, table=table)
    assert [(x.d_start, x.d_end, x.kind) for x in got] == [(0, 5, "novel"), (5, 10, "phonetic"), (10, 14, "novel")]
    assert al.phonetic_seeds("abcdE", "abcdE", table, PhoneticParams()) == []  # nothing differs
    assert al.phonetic_mapping("abz?", "aBzx", table) == [("a", "1", "a"), ("b", "2", "B"), ("z", "=", "z"), ("?", "?", "x")]
    with pytest.raises(ValueError):
        al.phonetic_mapping("a", "ab", table)


def test_pairs_do_not_depend_on_partitions(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [(1, " ".join(f"w{i}" for i in range(50, 90))), (2, "other words " * 10), (3, ""), (9, long)]
    df = spark.createDataFrame(texts, "id long, text string")
    pairs = spark.createDataFrame([(1, 9), (2, 9), (3, 9), (1, 9)], "digest_id long, source_id long")
    key = lambda d: sorted(map(tuple, d.collect()))
    one = key(al.align_pairs(pairs, df, df, P, together=1))
    assert one == key(al.align_pairs(pairs.repartition(7), df.repartition(3), df, P))
    assert (1, 9, 0, 0, 40, 50, 90, "exact") in one and (2, 9, 0, 0, 20, -1, -1, "novel") in one
