"""Flyer and branch feeds, product cards: each reader on small captures with what real ones get wrong."""

import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from feira.sources import channels as ch


def captures(spark, *payloads):
    """Captures in order; texts as they are, other values as JSON."""
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq long, payload string")


def at(text):
    return F.lit(text).cast("timestamp")


def by(df, key="external_id"):
    return {r[key]: r for r in df.collect()}


def test_cms_flyers_need_a_cover(spark):
    page = {"data": [{"id": 1, "name": " A ", "description": None, "cover": {"url": "/u/a.jpg"}, "pdf": {"url": "//u/a.pdf"}}, {"id": 2, "name": "B", "cover": None}, {"id": 3, "cover": {"url": "https://o/c.jpg"}, "pdf": None}]}
    got = by(ch.cms_flyers(captures(spark, page, "<html>challenge", None, {}), "https://h"), "flyer_id")
    assert set(got) == {1, 3}
    assert (got[1].name, got[1].description, got[1].cover_url, got[1].pdf_url, got[1].pages) == ("A", "", "https://h/u/a.jpg", "https://h/u/a.pdf", [])
    assert (got[3].name, got[3].cover_url, got[3].pdf_url) == ("", "https://o/c.jpg", None)


def test_covered_flyers_say_whom_they_are_for(spark):
    stores = [{"nid": i, "name": f"Marca  L{i}", "url": f"/ofertas/ceara/l{i}"} for i in (3, 1, 2)] + [{"nid": 9, "name": "Marca Fora", "url": "/ofertas/piaui/l9"}]

    def flyer(i, covers, **more):
        return {"id_oferta": i, "title": " T ", "start_date": "01/06/1997", "end_date": "02/06/1997", "lojas": [{"nid": n} for n in covers], "images": [{"url": "b"}, {"url": ""}, {"url": "a"}]} | more

    offers = [flyer(1, [1, 2, 3, 9]), flyer(2, [1, 3]), flyer(3, [2]), flyer(4, [9]), flyer(5, [1], images=[]), flyer(6, [1], end_date="31/05/1997"), flyer(7, [1], end_date="1/6/97", title=None), flyer(8, [1], end_date="01/06/1997"), flyer(9, [1], start_date="99/99/1997")]
    got = by(ch.covered_flyers(captures(spark, {"lojas": stores, "ofertas": offers}, {"ofertas": offers}), "ceara", "Ceará", "Marca ", at("1997-06-01 12:00:00")), "flyer_id")
    assert set(got) == {1, 2, 3, 7, 8, 9}  # 8 ends today, 7 has no readable end
    assert got[1].description == "Todas as lojas do Ceará"
    assert got[2].description == "Todas as lojas do Ceará, exceto: L2"
    assert got[3].description == "Lojas: L2"
    assert got[1].pages == ["b", "a"] and got[1].cover_url == "b" and got[1].name == "T"
    assert got[1].posted_at == datetime(1997, 6, 1) and got[1].valid_until == datetime(1997, 6, 2, 23, 59, 59)
    assert got[7].valid_until is None and got[7].name == "Jornal de Ofertas" and got[9].posted_at is None


def test_stamped_flyers_drop_what_ended(spark):
    rows = [
        {"id_encarte": 1, "descricao": " x ", "arquivo": "up/a b~*é.pdf", "inicio": "1997-05-30 00:00:00", "validade": "1997-06-01 12:00:00"},
        {"id_encarte": 2, "arquivo": "a", "validade": "1997-06-01 11:59:59"},
        {"id_encarte": 3, "arquivo": "", "validade": None},
        {"id_encarte": None, "arquivo": "a"},
        {"id_encarte": 5, "arquivo": "a", "validade": "logo"},
    ]
    got = by(ch.stamped_flyers(captures(spark, {"status": "success", "data": rows}, {"status": "error", "data": [rows[0] | {"id_encarte": 8}]}), "https://b", at("1997-06-01 12:00:00")), "flyer_id")
    assert set(got) == {1, 5}
    assert got[1].pdf_url == "https://b/api-proxy.php?file=up%2Fa%20b~%2A%C3%A9.pdf" == got[1].cover_url and got[1].name == "x"
    assert got[5].name == "Encarte" and got[5].valid_until is None


def test_gallery_flyers_keep_the_order_of_pictures(spark):
    def picture(u):
        return f'<a class="e-gallery-item y" data-x="1" href=" {u}">'

    posts = [{"id": i, "date": d, "link": f"l{i}", "title": {"rendered": "<i>A</i> &amp; B"}} for i, d in ((1, "1997-05-18T12:00:00"), (2, "1997-05-18T11:59:59"), (3, "1997-06-01T00:00:00"), (4, "1997-06-01T00:00:00"))]
    html = [("l1", picture("https://x/2.JPG") + picture("https://x/1.webp") + picture("https://x/2.JPG") + picture("https://x/n.gif")), ("l2", picture("https://x/1.png")), ("l3", "<p>nada"), ("l9", picture("https://x/1.png"))]
    got = by(ch.gallery_flyers(captures(spark, posts), spark.createDataFrame(html, "link string, html string"), at("1997-06-01 12:00:00")), "flyer_id")
    assert set(got) == {1}
    assert got[1].pages == ["https://x/2.JPG", "https://x/1.webp"] and got[1].name == "A & B"


def test_sides_of_a_flyer_are_its_pages(spark):
    def item(t, u):
        return f'<div class="offers__item">\n<h3 class="a">{t}</h3> <img alt="" src="{u}">'

    html = item("Fim &amp; Semana – Frente", "/f-2024-05-02.jpg") + item("Quarta", "/q.jpg") + item("Fim &amp; Semana - verso", "/v-2024-05-03.jpg") + item("Fim &amp; Semana – 3", "/t.jpg") + "<h2>Ofertas anteriores</h2>" + item("Velho", "/o.jpg")
    got = by(ch.sided_flyers(captures(spark, html, None, "")), "name")
    assert set(got) == {"Fim & Semana", "Quarta"}
    assert got["Fim & Semana"].pages == ["/f-2024-05-02.jpg", "/v-2024-05-03.jpg", "/t.jpg"]
    assert got["Fim & Semana"].posted_at == datetime(2024, 5, 3) and got["Quarta"].posted_at is None
    assert got["Quarta"].flyer_id == zlib.crc32(b"Quarta")


def test_pickup_points(spark):
    def point(i, **more):
        address = {"street": "Rua A", "number": "7", "neighborhood": None, "city": " Fortaleza ", "state": "CE", "geoCoordinates": [-38.5, -3.7]} | more.pop("address", {})
        return {"pickupPoint": {"id": i, "friendlyName": f" N{i} ", "isActive": True, "address": address} | more}

    page = {"items": [point("a"), point("b", isActive=False), point("c", address={"geoCoordinates": [1.0]}), point("d", friendlyName=" "), point("e", address={"street": None, "city": None, "state": ""}), {"pickupPoint": None}, point("a", friendlyName="later")]}
    got = by(ch.pickup_branches(captures(spark, page, {"items": [point("a", friendlyName="page 2"), point("f", address={"number": None})]})))
    assert set(got) == {"a", "f"}
    assert (got["a"].name, got["a"].address, got["a"].latitude, got["a"].longitude) == ("Na", "Rua A 7, Fortaleza, CE", -3.7, -38.5)
    assert got["f"].address == "Rua A, Fortaleza, CE"


def test_listed_and_located_branches(spark):
    row = {"id": 1, "name": " A ", "address": " R 1 "}
    got = by(ch.listed_branches(captures(spark, {"data": [row, {"id": 2, "name": "", "address": "x"}]}, [row | {"name": "again"}, {"id": 3, "name": "C", "address": "R 3"}], "no json", {"data": None})))
    assert {k: (r.name, r.address, r.latitude) for k, r in got.items()} == {"1": ("A", "R 1", None), "3": ("C", "R 3", None)}
    rows = [{"id": 1, "name": "Loja A", "address": "R", "coordinates": " -3.7 , -38.5 "}, {"id": 2, "name": "B", "address": "R", "coordinates": "-3.7"}, {"id": 3, "name": "C", "address": "R", "coordinates": "a,b"}, {"id": 4, "name": "Loja ", "address": "R", "coordinates": "1,2"}]
    got = by(ch.located_branches(captures(spark, {"data": rows})))
    assert {k: (r.name, r.latitude, r.longitude) for k, r in got.items()} == {"1": ("A", -3.7, -38.5), "4": ("Loja", 1.0, 2.0)}


def test_embedded_branches_lose_points_outside_the_state(spark):
    def store(i, **more):
        return {"loja_id": i, "n": f"Marca  L{i}", "lat": "-3.7", "lon": -38.5, "logradouro": " Av. B, 1 ,", "complemento": " ,", "c": "Fortaleza", "uf": "CE"} | more

    stores = [store(1), store(2, lat=-20.4, lon=-54.6), store(3, uf="PI"), store(4, lat=None), store(5, logradouro=" , "), store(None), store(1, n="again")]
    html = f'<script>w = {{"assai":{{"lojas":{json.dumps(stores)}, "x": 1}}}};</script>'
    got = by(ch.embedded_branches(captures(spark, html, "<html>challenge</html>", None), "CE", "Marca ", (-7.9, -2.7, -41.5, -37.2)))
    assert {k: (r.name, r.address, r.latitude) for k, r in got.items()} == {"1": ("L1", "Av. B, 1, Fortaleza, CE", -3.7), "2": ("L2", "Av. B, 1, Fortaleza, CE", None), "4": ("L4", "Av. B, 1, Fortaleza, CE", None)}


def test_banner_branches(spark):
    def row(n, **more):
        return {"tipo": " Marca ", "estado": "Ceará", "nome": n, "endereco": "Rua  X  - ", "bairro": "-", "cidade": "Fortaleza"} | more

    got = by(ch.banner_branches(captures(spark, [row("A"), row("B", tipo="Minuto"), row("C", estado="Piauí"), row(" "), row("D", endereco=None, cidade=" "), row("E", estado="CE"), row("A", cidade="Later")]), "Marca", ("Ceará", "CE")))
    assert {k: r.address for k, r in got.items()} == {"A": "Rua X, Fortaleza", "E": "Rua X, Fortaleza"}


@pytest.mark.parametrize(
    ("text", "city", "expected"),
    [
        ("Fortaleza-Ce/ Bairro: Centro – Av. Y, 2100.", "Fortaleza", "Centro - Av. Y, 2100, Fortaleza, CE"),
        ("BR-116, 9800 - Messejana, Fortaleza - CE, 60821-000, Brasil", "Fortaleza", "BR-116, 9800 - Messejana, Fortaleza - CE"),
        ("Maranguape/CE - Rua Z , 5 (CE-065)", "Maranguape", "Rua Z, 5, Maranguape, CE"),
        ("Rua W, 1, fortaleza", "Fortaleza", "Rua W, 1, fortaleza, CE"),
        ("Rua W, 1", "", "Rua W, 1, CE"),
        (" ,. ", "Fortaleza", None),
    ],
)
def test_feed_address(spark, text, city, expected):
    row = spark.createDataFrame([(text, city)], "t string, c string").select(ch.feed_address(F.col("t"), F.col("c"), "CE").alias("a")).first()
    assert row.a == expected


def test_city_branches(spark):
    rows = [{"idloja": 1, "marca": "MA", "nome_exibicao": "Marca  Sul ", "endereco": "Rua 1"}, {"idloja": 2, "marca": "SM", "nome_exibicao": "X", "endereco": "Rua 1"}, {"idloja": None, "marca": "MA", "nome_exibicao": "X", "endereco": "R"}, {"idloja": 4, "marca": "MA", "nome_exibicao": "Marca ", "endereco": "R"}]
    page = captures(spark, {"status": "success", "data": rows}, {"status": "error", "data": rows}).withColumn("city", F.lit(" Crato "))
    got = by(ch.city_branches(page, "MA", "Marca ", "CE"))
    assert {k: (r.name, r.address) for k, r in got.items()} == {"1": ("Sul", "Rua 1, Crato, CE"), "4": ("Marca", "R, Crato, CE")}


def test_branches_of_html_pages(spark):
    html = "<h3>Marca Super &#8211; Loja Norte</h3><p>\n R.  José, 6 - B, 60873-195 </p><h3>Marca Super - Loja Sem</h3><p>em breve</p><h3>Marca Super – Loja Sul </h3><div><p>Av. K, 60000-000<br></p></div>"
    got = by(ch.page_branches(captures(spark, html, html.replace("José", "Outra"), None), "Marca Super"))
    assert {k: (r.name, r.address) for k, r in got.items()} == {"Norte": ("Marca Norte", "R. José, 6 - B, 60873-195"), "Sul": ("Marca Sul", "Av. K, 60000-000")}
    html = "<h2 class='t'> MARCA Norte </h2><p>x</p><p><strong>Endereço:</strong> Rua 1 </p><h2>Marca Sem</h2><p>nada</p><h2>Marca Sul</h2><p><strong>Endereço:</strong>Rua 2</p>"
    got = by(ch.heading_branches(captures(spark, html), "Marca"))
    assert {k: r.address for k, r in got.items()} == {"Norte": "Rua 1", "Sul": "Rua 2"}


def test_product_cards(spark):
    def card(i, name, tail, extra=""):
        return f'<div><a href="/produto/{i}/s"><img src="x" alt="Foto {i}"></a><a href="/produto/{i}/s"><b>{name}</b> R$ 9,99</a>{extra}<span>{tail}</span></div>'

    def named(i, name):
        return f'<a href="/produto/{i}/s">{name}</a>'

    page = "".join([
        '<a href="/outra/1">x</a> R$ 1,00',
        card(1, "Café longo", "R$ 10,00 10% OFF sai por R$ 9,00", named(1, "Café")),
        card(2, "Leite", "Leve 3 e pague 2 sai por R$ 3,00", named(2, "Leite")),
        card(3, "Chá", "50% na 2ª unidade Sai por R$ 1,00", named(3, "Chá")),
        card(4, "Pão", "sai por R$ 99,00", named(4, "Pão")),
        f'<a href="/produto/5/s"><img alt="Só foto"></a> R$ 1.234,56',
        named(6, "Sem preço"),
        card(1, "Clone", "R$ 0,50", named(1, "X")),
        card(12, "Um dois", "", named(12, "Doze")),
    ])
    got = by(ch.product_cards(captures(spark, page, named(6, "Mais tarde") + "R$ 2,00" + card(2, "z", "", named(2, "z")), None, "")), "item_id")
    assert {k: (r.name, r.price_cents, r.regular_cents, r.offer) for k, r in got.items()} == {
        "1": ("Café", 900, 999, "10% OFF"),
        "2": ("Leite", 999, None, "Leve 3 e pague 2"),
        "3": ("Chá", 999, None, "50% na 2ª unidade"),
        "4": ("Pão", 999, None, None),
        "5": ("Só foto", 123456, None, None),
        "6": ("Mais tarde", 200, None, None),
        "12": ("Doze", 999, None, None),
    }


def test_cards_of_one_product_side_by_side(spark):
    def card(i, name, tail):
        return f'<div class="c"><p><a href="/produto/{i}/s"><img src="x"></a><br></p><a href="/produto/{i}/s">{name}</a><div><span>{tail}</span></div><a href="/produto/{i}/s">{name} R$ 99,99</a></div>'

    page = card(11230, "P11230", "R$ 5,00") + "\n" + card(11230, "Outro", "R$ 0,01 20% OFF sai por R$ 0,005") + card(2, "Leite", "R$ 3,00")
    one = '<section><div><a href="/produto/7/s">Nome longo</a></div><div><a href="/produto/7/s">Nome</a></div>R$ 4,00</section><section><a href="/produto/7/s">N</a>R$ 1,00</section>'
    nameless = '<div><a href="/produto/8/s"></a>R$ 1,00</div><div><a href="/produto/8/s">Oito</a>R$ 8,00</div>'
    got = by(ch.product_cards(captures(spark, page, one + nameless)), "item_id")
    assert {k: (r.name, r.price_cents, r.regular_cents, r.offer) for k, r in got.items()} == {
        "11230": ("P11230", 500, None, None), "2": ("Leite", 300, None, None), "7": ("Nome", 400, None, None), "8": ("Oito", 800, None, None),
    }


def test_feeds_of_empty_tables(spark):
    none = captures(spark, None).limit(0)
    assert ch.union_flyers({"a": ch.sided_flyers(none), "b": ch.cms_flyers(none, "h")}).count() == 0
    assert ch.pickup_branches(none).count() == ch.product_cards(none).count() == 0
