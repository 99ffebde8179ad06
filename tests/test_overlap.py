"""Word overlap of texts and codes against all pairs, with common words and without."""

import random

import pytest

from feira.functions.text import STOP
from feira.operators.warehouse import token_overlap


@pytest.mark.parametrize("common", [0, 3, 10, 1000])
def test_overlap_equals_all_pairs(spark, common):
    dice = random.Random(7)
    vocabulary = [a + b + c for a in "bcdf" for b in "aei" for c in ("lha", "rto", "nza")]
    assert not set(vocabulary) & set(STOP)
    weights = [1 / (i + 1) for i in range(len(vocabulary))]

    def some(most):
        return sorted(set(dice.choices(vocabulary, weights, k=dice.randint(1, most))))

    codes = [(f"{10_000_000 + i}", " ".join(some(5))) for i in range(150)]
    codes += [(f"{20_000_000 + i}", "bal ha " + vocabulary[0]) for i in range(12)] + [("1234", vocabulary[0]), ("30000000", None), ("30000001", "")]
    texts = [(i, some(6)) for i in range(120)] + [(900, [vocabulary[0]]), (901, []), (902, ["zzz"]), (903, vocabulary)]
    top = 9
    got = token_overlap(spark.createDataFrame(texts, "id long, words array<string>"), spark.createDataFrame(codes, "code string, description string"), top, common).collect()
    expected = set()
    for i, words in texts:
        scored = []
        for code, description in codes:
            own = {w for w in (description or "").split() if len(w) > 2}
            shared = len(own & set(words))
            if len(code) == 8 and shared:
                scored.append((-round(shared - (len(own) - shared) * 0.05, 4), len(description), code))
        expected |= {(i, code, -s, n) for n, (s, _, code) in enumerate(sorted(scored)[:top], 1)}
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
