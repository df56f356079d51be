import numpy as np
from hypothesis import given, settings, strategies as st

from sigloom.llm.gsaca import suffix_arrays


def check(strings):
    text = np.array([x for s in strings for x in [*s, 0]], np.int64)
    base = np.concatenate(([0], np.cumsum([len(s) + 1 for s in strings]))).astype(np.int64)
    got = suffix_arrays(text, base)
    for s, a, b in zip(strings, base, base[1:], strict=False):
        t = [*s, 0]
        assert (got[a:b] - a).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), max_size=40), min_size=1, max_size=6))
def test_small_alphabets(strings):
    check(strings)


def test_odd_strings():
    fib = [1], [2]
    for _ in range(9):
        fib = fib[1], fib[1] + fib[0]
    rng = np.random.default_rng(0)
    check([[5] * 300, fib[1], list(range(1, 200)), list(range(200, 0, -1)), [1, 2] * 150, [2, 1] * 150 + [3], []])
    check([list(rng.integers(1, 258, 700)) for _ in range(40)])
    check([list(rng.integers(1, 3, int(n))) for n in rng.integers(0, 400, 60)])
