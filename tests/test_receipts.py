"""Receipts: consensus of readings and baskets elsewhere, against plain versions and small cases."""

import random

import pytest

ITEM_FIELDS = ("receipt_id", "place", "weight", "line_no", "name", "code", "code_reads", "qty", "unit", "unit_price", "discount", "total", "printed_total")


def plain_ratio(a, b):
    """Best of all windows of the longer text, by dynamic programming."""

    def common(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = row[:]
            for j, e in enumerate(y, 1):
                row[j] = last[j - 1] + 1 if c == e else max(last[j], row[j - 1])
        return row[-1]

    if not a or not b:
        return 100.0 if a == b else 0.0
    a, b = sorted((a, b), key=len)
    n = len(a)
    pairs = [(a, b)] + ([(b, a)] if len(a) == len(b) else [])
    return max(200 * common(x, w) / (n + len(w)) for x, y in pairs for w in {y[max(0, i) : i + n] for i in range(1 - n, len(y))})


def plain_vote(values, weights):
    best = (None, 0.0)
    for v in values:
        if v is None:
            continue
        w = sum(w2 for u, w2 in zip(values, weights, strict=False) if u is not None and abs(u - v) <= 0.02)
        if w > best[1]:
            best = (v, w)
    return best


def plain_consensus(rows):
    lines, out = {}, {}
    rows = sorted(rows, key=lambda r: r["place"])
    for r in rows:
        if r["line_no"] is not None:
            lines.setdefault(r["line_no"], []).append(r)
    for r in rows:
        if r["line_no"] is None:
            for own in lines.values():
                if plain_ratio((r["name"] or "").upper(), (own[0]["name"] or "").upper()) >= 80:
                    own.append(r)
                    break
    for n, own in lines.items():
        w = [r["weight"] for r in own]
        total, votes = plain_vote([r["total"] for r in own], w)
        fair = [r for r in own if r["discount"] is None or (r["total"] is not None and 0 < r["discount"] <= r["total"])]
        sound = [r["printed_total"] is not None and None not in (r["qty"], r["unit_price"], r["total"]) and abs(r["qty"] * r["unit_price"] - (r["discount"] or 0) - r["total"]) <= 0.03 for r in own]
        if total is not None:
            good = [r for r, s in zip(own, sound, strict=True) if s and r["total"] is not None]
            bad = [r for r, s in zip(own, sound, strict=True) if not s and r["total"] is not None]
            if good and bad and not any(abs(r["total"] - total) <= 0.02 for r in good):
                total = max(good, key=lambda r: r["weight"])["total"]
        top = [r["name"] or "" for r in own if r["weight"] >= max(w) - 1e-9]
        name = min([x for x in top if plain_ratio(top[0].upper(), x.upper()) >= 65] or top[:1], key=len) or top[0]
        votes_of = {}
        reads = {}
        for r in own:
            if r["code"]:
                votes_of[r["code"]] = votes_of.get(r["code"], 0) + r["weight"]
            for x in r["code_reads"]:
                reads[x] = reads.get(x, 0) + r["weight"]
        out[n] = (
            name, max(votes_of, key=votes_of.get) if votes_of else None, sorted(reads, key=lambda x: -reads[x])[:6], plain_vote([r["qty"] for r in own], w)[0], next((r["unit"] for r in own if r["unit"]), None),
            plain_vote([r["unit_price"] for r in own], w)[0], plain_vote([r["discount"] for r in fair], [r["weight"] for r in fair])[0], total, plain_vote([r["printed_total"] for r in own if r["printed_total"] is not None], w)[0],
            len(own) > 1 and votes < sum(w) and total is not None and any(r["total"] is not None and abs(r["total"] - total) > 0.02 for r in own),
        )
    return out


def test_ratio_of_the_best_place():
    from feira.operators.consensus import part_ratio

    rng = random.Random(5)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(9))) for _ in range(2))
        assert abs(part_ratio(a, b) - plain_ratio(a, b)) < 1e-9, (a, b)


@pytest.mark.parametrize("seed", [1, 2])
def test_consensus_equals_a_plain_merge(spark, seed):
    from feira.operators.consensus import ITEM, consensus

    rng = random.Random(seed)
    some = lambda *v: rng.choice(v)
    rows, receipts = [], {}
    for receipt in range(60):
        place = 0
        for reading in range(rng.randrange(1, 5)):
            weight = some(1.0, 0.75, 0.5)
            for line in range(rng.randrange(1, 5)):
                total = some(None, 10.0, 10.01, 10.03, 13.0)
                row = (
                    receipt, place, weight, some(line, line, line, None), some(f"ARROZ TIPO {line}", f"arroz tipo {line} 5kg", f"ARR0Z TIP {line}", "zzz", None), some(None, "789", "780", ""), some([], ["1"], ["2", "1"], list("34567")),
                    some(None, 2.0, 3.0), some(None, "", "kg", "un"), some(None, 5.0, 5.01), some(None, None, 0.0, 1.0, 99.0), total, some(None, total, 10.0),
                )
                rows.append(row)
                receipts.setdefault(receipt, []).append(dict(zip(ITEM_FIELDS, row, strict=True)))
                place += 1
    got = consensus(spark.createDataFrame(rows, ITEM)).collect()
    want = {(k, n): v for k, own in receipts.items() for n, v in plain_consensus(own).items()}
    assert {(r.receipt_id, r.line_no): tuple(r)[2:] for r in got} == want


def test_a_vote_with_less_than_all_weight_is_contested(spark):
    from feira.operators.consensus import ITEM, consensus

    item = lambda place, weight, total, **more: tuple({**dict.fromkeys(ITEM_FIELDS), "receipt_id": 1, "place": place, "weight": weight, "line_no": 1, "name": "CAFE", "code_reads": [], "total": total, **more}[f] for f in ITEM_FIELDS)
    one = lambda *items: consensus(spark.createDataFrame(items, ITEM)).first()
    assert one(item(0, 1.0, 9.0), item(1, 1.0, 9.01)).contested is False
    r = one(item(0, 1.0, 9.0), item(1, 0.25, 12.0))  # far below half of the weight, yet contested
    assert (r.total, r.contested) == (9.0, True)
    r = one(item(0, 1.0, 9.0), item(1, 1.0, 9.0), item(2, 0.5, 12.0, qty=2.0, unit_price=6.0, printed_total=12.0))
    assert (r.total, r.contested) == (12.0, True)  # printed and right arithmetic go before the vote


# ---- baskets elsewhere

GOODS = "id string, name string, brand string, gtin string, subcategory string, unit string, amount double, pack_count int"


def goods(name, brand="", gtin=None, kind="Arroz", unit="g", amount=1000.0):
    return (name, brand, gtin, kind, unit, amount, 1)


def compared(spark, lines, products, offers):
    from feira.operators.baskets import best_split, compare_baskets, considered, lines_at_chains

    line = spark.createDataFrame([(1, i, p, c, float(q)) for i, (p, c, q) in enumerate(lines)], "receipt_id long, line_no int, product_id string, paid_cents long, quantity double")
    product = spark.createDataFrame([(k, *v) for k, v in products.items()], GOODS)
    ranked = spark.createDataFrame(offers, "product_id string, retailer_id string, price_cents long")
    used = considered(line, product)
    at = lines_at_chains(line, product, ranked)
    baskets = compare_baskets(used, at)
    return {(r.line_no, r.retailer_id): r for r in at.collect()}, {r.retailer_id: r for r in baskets.collect()}, best_split(used, at, baskets).collect()


RICE, BAG = goods("Arroz Agulhinha Tipo 1 Camil 1kg", "Camil"), goods("Arroz Agulhinha Tipo 1 Extremo Sul 5kg", "Extremo Sul", amount=5000.0)


def test_the_same_product_and_one_of_its_kind(spark):
    at, baskets, split = compared(spark, [("rice", 550, 2)], {"rice": RICE, "bag": BAG}, [("rice", "P", 589), ("bag", "A", 1899)])
    assert (at[0, "A"].kind, at[0, "A"].pack_cents, at[0, "A"].cost_cents, at[0, "A"].product_id) == ("similar", 1899, 760, "bag")
    assert (at[0, "P"].kind, at[0, "P"].cost_cents) == ("same", 1178)
    assert baskets["A"].best_single and baskets["A"].place == 1 and not baskets["P"].best_single
    assert (split[0].lines, split[0].total, split[0].retailers) == (1, 760, "A")


def test_goods_of_another_kind_are_none(spark):
    others = {
        "dog": goods("Ração Cães Dog Chow Cordeiro e Arroz 1kg", "Dog Chow"),
        "litre": goods("Arroz Agulhinha Tipo 1 Importado 1l", unit="ml"),
        "tag": goods("Arroz Agulhinha Tipo 1 Outro 1kg", kind="Feijao"),
        "capsule": goods("Arroz Agulhinha Tipo 1 Cápsula 10g", amount=10.0),
    }
    at, _, split = compared(spark, [("rice", 550, 1)], {"rice": RICE, **others}, [(k, k, 2190 if k == "capsule" else 400) for k in others])
    assert at == {} and (split[0].considered, split[0].lines, split[0].total) == (1, 0, None)
    one_word = {"plain": goods("Arroz 1kg"), "cousin": goods("Arroz Parboilizado 1kg")}
    assert compared(spark, [("plain", 500, 1)], one_word, [("cousin", "A", 400)])[0] == {}


def test_a_barcode_under_two_names_and_missing_lines(spark):
    products = {"mine": goods("Arroz Agulhinha Camil 1kg", gtin="7891234567895"), "theirs": goods("Arroz Camil Tipo 1 Pacote 1kg", gtin="07891234567895"), "beans": goods("Feijao Carioca Tipo 1 Camil 1kg", "Camil", kind="Feijao")}
    lines = [("mine", 550, 1), ("beans", 800, 1), ("beans", None, 1), ("unknown", 100, 1)]
    at, baskets, split = compared(spark, lines, products, [("mine", "A", 520), ("theirs", "P", 489), ("beans", "A", 780)])
    assert (at[0, "P"].kind, at[0, "P"].product_id, at[0, "P"].cost_cents) == ("same", "theirs", 489)
    assert baskets["A"].place == 1 and baskets["A"].best_single and baskets["A"].missing == ""
    assert (baskets["P"].missing, baskets["P"].paid, baskets["P"].best_single) == ("1", 550.0, False)
    assert (split[0].considered, split[0].lines, split[0].total, split[0].retailers) == (2, 2, 489 + 780, "A,P")


def test_baskets_equal_all_pairs(spark):
    """Random goods of few words and many prices: the cheapest of a kind within the band, by comparing all with all."""
    import math

    rng = random.Random(9)
    words = ["arroz", "branco", "fino", "longo"]
    products = {f"p{i:03d}": goods(" ".join(rng.choices(words, k=rng.randrange(1, 5))), "", None, rng.choice(["Arroz", "Arroz", "Outros", ""]), rng.choice(["g", "g", "ml", "un"]), float(rng.choice([1, 250, 500, 900, 1000, 5000]))) for i in range(120)}
    offers = [(p, f"R{r}", int(math.exp(rng.uniform(4, 8)))) for p in products for r in range(4) if rng.random() < 0.3]
    lines = [(rng.choice(list(products)), rng.choice([None, 1, int(math.exp(rng.uniform(4, 8)))]), rng.choice([1, 2, 0.5])) for _ in range(150)]
    at = compared(spark, lines, products, offers)[0]
    core = {p: v[0].split() for p, v in products.items()}
    want = {}
    for n, (p, paid, qty) in enumerate(lines):
        if paid is None:
            continue
        size = products[p][5]
        for r in {o[1] for o in offers}:
            same = [c for q, s, c in offers if q == p and s == r]
            if same:
                want[n, r] = ("same", p, math.floor(min(same) * qty + 0.5))
                continue
            if products[p][3] in ("", "Outros") or products[p][4] == "un" or len(core[p]) < 2:
                continue
            found = []
            for q, s, c in offers:
                low = min(c2 for q2, _, c2 in offers if q2 == q) / products[q][5]
                alike = products[q][3:5] == products[p][3:5] and sum(w in core[q] for w in core[p]) / len(core[p]) >= 0.75
                if s == r and q != p and alike and 1 / 3 <= low / (paid / size) <= 3:
                    found.append((c / products[q][5], q))
            if found:
                want[n, r] = ("similar", min(found)[1], math.floor(min(found)[0] * (qty * size) + 0.5))
    got = {k: (v.kind, v.product_id, v.cost_cents) for k, v in at.items()}
    assert {k: (got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}
    assert sum(v[0] == "similar" for v in want.values()) > 10


# ---- lines and products


def test_words_that_are_alike_are_all_found(spark):
    from pyspark.sql import functions as F

    from feira.functions.values import word_similarity
    from feira.operators.receipts import similar_words

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé1") for _ in range(n))
    own = {word(rng.randrange(1, 9)) for _ in range(250)} | {"linguica", "macarrao", "frango", "integral"}
    cut = lambda w: "".join(c for c in w if rng.random() < 0.7)
    printed = {cut(w) for w in own} | {w[: rng.randrange(1, 9)] for w in own} | {w.replace("a", "b", 1) for w in own} | {"lngc", "mcrr", "frngo", ""}
    p, o = spark.createDataFrame([(x,) for x in printed], "p string"), spark.createDataFrame([(x,) for x in own], "o string")
    want = p.crossJoin(o).filter("p <> ''").withColumn("sim", word_similarity(F.col("p"), F.col("o"))).filter("sim > 0")
    got = similar_words(p, o)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500


def test_ties_of_a_receipt_line(spark):
    from feira.operators.receipts import match_lines

    product = spark.createDataFrame(
        [(1, "Cafe Pilao Torrado 500g", "Pilao", None), (2, "Torrado Cafe Pilao 500g", "Pilao", None), (3, "Cerveja Brahma Lata", "x", None), (4, "Cerveja Brahma Lata", "y", None), (5, "Suco Uva Integral", "z", None), (6, "Suco Uva Integral", "w", None)],
        "id long, name string, brand string, gtin string",
    )
    ranges = spark.createDataFrame([(2, 1500, 1600), (3, 300, 350), (4, 500, 550), (5, 300, 350), (6, 340, 360)], "product_id long, low long, high long")
    lines = [(1, "CAFE PILAO TORRADO 500G", None), (2, "CERVEJA BRAHMA LATA", None), (3, "CERVEJA BRAHMA LATA", 520), (4, "CERVEJA BRAHMA LATA", 900), (5, "SUCO UVA INTEGRAL", 345), (6, "CERVEJA BRAHMA LATA", 320)]
    got = {r.line_id: r.product_id for r in match_lines(spark.createDataFrame(lines, "line_id long, name string, paid_cents long"), product, ranges=ranges).collect()}
    # one pack under two names: the one with a price; two brands: the price paid, where it tells them apart
    assert got == {1: 2, 3: 4, 6: 3}
