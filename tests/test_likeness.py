"""Names that are alike, against comparing all with all."""

import random
import re
from difflib import SequenceMatcher

import pytest


def plain(text):
    return " ".join(re.findall("[a-z0-9]+", (text or "").lower()))


def score(a, b):
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    return max(SequenceMatcher(None, a, b, autojunk=False).ratio(), 2 * len(x & y) / (len(x) + len(y)))


def names(rng, n):
    words = ["leite", "ninho", "380g", "integral", "po", "cafe", "a", "x1", "aaaa", "abababab", "macarrao", "instantaneo"]
    out = ["", "abcdefgh", "abxcdyefzgh", "leite ninho 380g", "ninho leite 380g", "a", "b", "ab", "ba"]
    while len(out) < n:
        own = list(" ".join(rng.sample(words, rng.randrange(1, 5))))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(own) + 1)
            own[at : at + rng.randrange(2)] = rng.choice(["", "e", " ", "zq"])
        out.append(plain("".join(own)))
    return out


@pytest.mark.parametrize("least", [0.40, 0.62, 0.75, 0.88])
def test_pairs_equal_all_pairs(spark, least):
    from feira.operators.likeness import alike_names, most_alike

    rng = random.Random(int(least * 100))
    left, right = names(rng, 90), names(rng, 80)
    a, b = (spark.createDataFrame([(x, i % 2) for i, x in enumerate(side)], f"{c} string, g int") for side, c in ((left, "a"), (right, "b")))
    want = {(x, y): score(x, y) for x in left for y in right if score(x, y) >= least}
    got = {(r.a, r.b): r.score for r in alike_names(a, b, least).collect()}
    assert got == want and ("leite ninho 380g", "ninho leite 380g") in got
    top = {x: max(s for (p, _), s in want.items() if p == x) for x, _ in want}
    assert {(r.a, r.b, r.score) for r in most_alike(a, b, least).collect()} == {(x, y, s) for (x, y), s in want.items() if s == top[x]}
    inside = {(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if i % 2 == j % 2 and score(x, y) >= least}
    assert {(r.a, r.b) for r in alike_names(a, b, least, ["g"]).collect()} == inside


def test_lookup_by_number_code_and_name(spark):
    from feira.operators.discovery import looked_up

    flagged = spark.createDataFrame([(1, 11, "Leite Ninho 380g", None), (2, 12, "Café Pilão 500g", "7891000"), (3, 13, "Arroz Branco", None), (4, 14, "Arroz Branco", None)], "place int, id int, name string, gtin string")
    rows = [(1, "leite ninho", None), (3, "cafe", "7891000"), (99, "Ninho Leite 380G", None), (98, "branco arroz", None), (97, "Sabonete", None), (2, "Ninho Leite 380g", None)]
    got = {r.num: (r.how, r.id) for r in looked_up(spark.createDataFrame(rows, "num int, name string, gtin string"), flagged).collect()}
    assert got == {1: ("place", 11), 3: ("barcode", 12), 99: ("name", 11), 98: ("name", 13), 2: ("name", 11)}


def test_images_of_reordered_names(spark):
    from feira.operators.discovery import image_matches

    product = spark.createDataFrame([(1, "Leite Ninho 380g", None), (2, "Sabão", "Ype")], "id int, name string, brand string")
    found = [(1, "search", "Ninho Leite 380g", None, "a"), (1, "search", "Ninho Leite", None, "b"), (2, "search", "nada", "YPE", "c"), (2, "search", "Sabao", None, "d")]
    got = {r.id: (r.image, r.confidence) for r in image_matches(product, spark.createDataFrame(found, "id int, kind string, name string, brand string, image string")).collect()}
    assert got == {1: ("a", 1.0), 2: ("c", 1.0)}


def test_evidence_has_no_limit_of_branches(spark):
    from feira.operators.discovery import branch_evidence

    branch = spark.createDataFrame([(i, "A", f"Loja Centro {i}") for i in range(60)] + [(100, "B", "Loja Centro 7")], "branch_id int, chain string, name string")
    flyers = spark.createDataFrame([(1, "A", "LOJA CENTRO 7"), (2, "B", "Loja Centro"), (3, "A", "Natal"), (4, "A", None)], "flyer_id int, chain string, title string")
    got = {r.flyer_id: (r.branch_id, r.ratio) for r in branch_evidence(flyers, branch).collect()}
    assert got == {1: (7, 1.0), 2: (100, round(22 / 24, 6))}


def test_numbered_names_meet_few_others(spark, monkeypatch):
    """Names that share all letters but some digits: a pair of all with all before; blocks of a few names give the same."""
    from feira.operators import likeness

    monkeypatch.setattr(likeness, "BLOCK", 70)
    monkeypatch.setattr(likeness, "STRIP", 16)
    left, right = [f"customer {i:09d}" for i in range(0, 400, 2)] + ["zz", "loja"], [f"customer {i:09d} x" for i in range(399)] + ["zzz", "loj a"]
    a, b = (spark.createDataFrame([(x, "k") for x in side], f"{c} string, g string") for side, c in ((left, "a"), (right, "b")))
    pairs = likeness._better_pairs(a, b, 0.62, ["g"])
    assert pairs.columns == ["g", "a", "b"] and len(left) - 1 <= pairs.count() < 10 * len(left)
    want = {}
    for x in left:
        best = max(score(x, y) for y in right)
        want |= {(x, y): best for y in right if score(x, y) == best >= 0.62}
    assert {(r.a, r.b): r.score for r in likeness.most_alike(a, b, 0.62, ["g"]).collect()} == want
