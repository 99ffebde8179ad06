"""Cases of the name functions."""

import pytest
from pyspark.sql import functions as F

from feira.functions import text as T
from feira.functions import values as V


def one(spark, function, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(function(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Arroz Branco 5kg", (5000, "g", 1)),
        ("Leite Integral 1L", (1000, "ml", 1)),
        ("Cerveja Lata 350ml 12 unidades", (350, "ml", 12)),
        ("Maminha Bovina Bandeja Kg", (1000, "g", 1)),
        ("Batata Doce Quilo", (1000, "g", 1)),
        ("Esponja", (1, "un", 1)),
        ("Suco 1,5 L", (1500, "ml", 1)),
    ],
)
def test_parse_size(spark, name, want):
    assert tuple(one(spark, T.parse_size, name)) == want


@pytest.mark.parametrize(
    ("name", "category", "sub"),
    [
        ("Macarrão Instantâneo sabor Picanha", "Mercearia", "Macarrao"),
        ("Molho de Tomate", "Mercearia", "Molho"),
        ("Papel Higiênico Neve", "Higiene e beleza", "Papel Higienico"),
        ("Água Sanitária", "Limpeza", "Agua Sanitaria"),
        ("Carne de Frango", "Carnes e peixes", "Frango"),
        ("Boneca", "Outros", ""),
        ("LASANHA DE FRANGO AO MOLHO 600G", "Mercearia", "Lasanha"),
        ("Espaguete Fino 500g", "Mercearia", "Espaguete"),
        ("Abobrinha Verde Kg", "Hortifruti", "Abobrinha"),
        ("Salsicha Viena", "Carnes e peixes", "Salsicha"),
        ("Guardanapo Folha Dupla", "Limpeza", "Guardanapo"),
        ("Sorvete de Creme 2L", "Laticínios e frios", "Sorvete"),
        ("Pizza Mussarela 400g", "Mercearia", "Pizza"),
        ("BISTECA SUINA CONGELADA KG", "Carnes e peixes", "Bisteca"),
        ("Bebida Láctea Morango 250ml", "Laticínios e frios", "Bebida Lactea"),
        ("Leite Condensado Lata 395g", "Mercearia", "Leite Condensado"),
        ("Peito de Peru Fatiado", "Laticínios e frios", "Peito de Peru"),
        ("Biscoito Sabor Chocolate 140g", "Padaria e biscoitos", "Biscoito"),
        ("Peixe Bovino", "Carnes e peixes", ""),
        ("Toalha e rodo", "Limpeza", "Rodo"),
        ("Conjunto novo grande para milho verde", "Mercearia", "Milho"),
    ],
)
def test_category(spark, name, category, sub):
    row = T.with_category(spark.createDataFrame([(name,)], "name string")).first()
    assert (row.category, row.subcategory) == (category, sub)


def test_display_name(spark):
    assert one(spark, T.display_name, "LEITE UHT DE  VACA 1L") == "Leite UHT de Vaca 1l"
    assert one(spark, T.display_name, "ABOBORA JAPONESA/CABOTIA") == "Abobora Japonesa/Cabotia"
    assert one(spark, T.display_name, "Leite Integral") == "Leite Integral"


def test_folding_handles_composed_and_combining_accents(spark):
    assert one(spark, T.clean, "  Açúcar\tCafé ") == "acucar cafe"


def test_codes(spark):
    assert one(spark, V.normalize_gtin, "789-1000100103") == "07891000100103"
    assert one(spark, V.normalize_gtin, "2000000000017") is None
    assert one(spark, V.gs1_check, "7891000100103") == "7891000100103"
    assert one(spark, V.gs1_check, "7891000100104") is None
    assert one(spark, V.parse_money, "R$ 1.234,56") == 123456
    assert one(spark, V.strict_cents, "12,9") is None


def test_validity_across_new_year(spark):
    got = one(spark, lambda c: V.parse_validity(c, F.lit(2026)), "válidas de 30/12 a 05/01")
    assert (str(got.start), str(got.end)) == ("2025-12-30 03:00:00", "2026-01-06 02:59:59")
    assert one(spark, lambda c: V.parse_validity(c, F.lit(2026)), "31/02 a 05/03").start is None


def test_similarity(spark):
    assert one(spark, V.word_similarity, "integ", "integral") == 0.9
    assert one(spark, V.word_similarity, "lngc", "linguica") == 0.6
    assert one(spark, V.word_similarity, "mussarella", "mussarela") == 0.85


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Açúcar da casa Jko", "Açúcar da casa 1kg"),
        ("Arroz fino lkg", "Arroz fino 1kg"),
        ("Feijão 1ko", "Feijão 1kg"),
        ("Farinha I kq", "Farinha 1kg"),
        ("sem sal 20Og", "sem sal 200g"),
        ("Arroz 5kg", "Arroz 5kg"),
        ("Café 0,1kg", "Café 0,1kg"),
        ("Sabão 21kg", "Sabão 21kg"),
        ("Bijko", "Bijko"),
        ("Jkoy 500g", "Jkoy 500g"),
    ],
)
def test_fix_units(spark, text, want):
    assert one(spark, T.fix_units, text) == want


@pytest.mark.parametrize(
    ("line", "tokens", "size"),
    [
        ("LEITE INT DA SERRA 1L", ["leite", "int", "serra"], (1000, "ml", 1)),
        ("Arroz Branco Tipo 1 5kg", ["arroz", "branco"], (5000, "g", 1)),
        ("QJO PRATO", ["queijo", "prato"], (None, None, None)),
        ("PO FORTE500LIMA", ["po", "forte", "lima"], (500, None, 1)),
        ("VITAMINA B12 X", ["vitamina", "b12"], (None, None, None)),
        ("REFRIG 7UP", ["refrigerante", "7up"], (None, None, None)),
        ("REFRIG UVA 12X350ML", ["refrigerante", "uva"], (350, "ml", 12)),
        ("QUEIJO 1,5KG", ["queijo"], (1500, "g", 1)),
    ],
)
def test_receipt_lines(spark, line, tokens, size):
    assert one(spark, T.name_tokens, line) == tokens
    assert tuple(one(spark, T.receipt_size, line)) == size


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Supermercado Aurora", "aurora"),
        ("SUPER AURORÁ", "aurora"),
        ("Aurora Supermercados - Loja Norte", "aurora"),
        ("Aurora (Centro)", "aurora"),
        ("Mercadinho São Jorge Ltda", "sao jorge"),
        ("Tom's Club", "toms club"),
        ("Atacadão", "atacadao"),
        ("Beira Atacadista", "beira"),
        ("Supermercado", ""),
    ],
)
def test_chain_key(spark, name, want):
    assert one(spark, T.chain_key, name) == want


def test_addresses_times_and_queries(spark):
    assert one(spark, T.address_clean, "Rua A, 10, S/N, LOJA 01, Centro").replace(" ", "") == "RuaA,10,,,Centro"
    now = F.lit("2024-03-10 12:00:00").cast("timestamp")
    label = lambda c: T.when_label(c.cast("timestamp"), now)
    assert [one(spark, label, t) for t in ("2024-03-10 03:05:00", "2024-03-10 02:59:00", "2024-03-01 15:00:00", None)] == ["hoje às 00:05", "ontem às 23:59", "em 01/03 às 12:00", "em data não informada"]
    assert one(spark, T.query_words, " Pão-de  QUEIJO ") == ["pao", "de", "queijo"]
    assert one(spark, T.query_words, "a b c d e f g h") == ["a", "b", "c", "d", "e", "f"]
    assert one(spark, T.query_words, "x") == [] and one(spark, T.query_words, "y" * 61) == []
