"""Flyers and branches as chains publish them: five flyer feeds and eight branch feeds, each read into one form.

A capture is a row (seq, payload): ``seq`` orders the captures of a feed, ``payload`` is the JSON or HTML text as it came.
Readers are column expressions over a capture, so they split no work but by rows; what repeats is settled by one grouping
on its key, first by (seq, place within the capture). A payload that can't be read gives no rows. Brands, addresses of
hosts, states and bounds are parameters; patterns that the feeds' own formats fix stand at the top.

Flyers: flyer_id, name, description, cover_url, pdf_url, pages (image addresses in order), posted_at, valid_until.
Branches: external_id, name, address, latitude, longitude (null where the feed has none, to be looked up by address).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.functions.text import html_text
from feira.functions.values import parse_money
from feira.sources.domain import branches, prices, table, with_tables

# Formats of the feeds.
GALLERY_IMAGE = r'(?i)e-gallery-item[^>]*href="\s*(https://[^"\s]+\.(?:jpe?g|png|webp))"'
FLYER_ITEM = r'(?s)<div class="offers__item">\s*<h3[^>]*>(.*?)</h3>\s*<img[^>]*src="([^"]+)"'
SIDE = r"(?i)\s*[–-]\s*(?:Frente|Verso|\d+)\s*$"
FILE_DATE = r"(20\d\d-\d\d-\d\d)"
ARCHIVE = "Ofertas anteriores"
STORES_MARKER = '"lojas":'
PRICE = r"R\$\s*(\d{1,3}(?:\.\d{3})*,\d{2}|\d+[.,]\d{2})"
DEAL = r"(?i)sai por\s*" + PRICE
MULTI_BUY = r"\d+%\s+na\s+\d+\S*\s+unidade|leve\s+\d+\s+e\s+pague\s+\d+"
OFFER = r"(?i)\d+%\s*OFF|" + MULTI_BUY
#: A run of cards of one product: its link and all up to the next link to another product.
CARD = r'(?s)<a\b[^>]*href="/produto/([^/"]+)[/"](?:.*?)(?=<a\b[^>]*href="/produto/(?!\1[/"])|\z)'
CARD_LINK = r'(?s)<a\b[^>]*href="/produto/[^"]*"[^>]*>(.*?)</a>'
#: A link after a price: another card of the same product may begin there.
LINK_AFTER_PRICE = r'(?s)R\$.*?<a\b[^>]*href="/produto/'
MARKUP = r"(?s)<[^>]*>|[^<]+|<"
#: Markup that opens nothing: no closing tag belongs to it.
VOID = r"(?is)^<(?:[!?]|(?:area|base|br|col|embed|hr|img|input|link|meta|source|track|wbr)\b|.*/>$)"

FLYER = ("flyer_id", "name", "description", "cover_url", "pdf_url", "pages", "posted_at", "valid_until")
BRANCH = ("external_id", "name", "address", "latitude", "longitude")


def _no_pages() -> Column:
    return F.array().cast("array<string>")


def _text(c: Column | str) -> Column:
    """Trimmed; null for nothing."""
    return F.nullif(F.trim(c), F.lit(""))


def _line(c: Column | str) -> Column:
    """On one line, single-spaced; null for nothing."""
    return F.nullif(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def _unbrand(name: Column, brand: str) -> Column:
    """The name without the brand before it; the whole name where nothing else is left."""
    rest = F.when(name.startswith(brand), F.substr(name, F.lit(len(brand) + 1))).otherwise(name)
    return F.coalesce(_text(rest), name)


def _items(captures: DataFrame, found: Column) -> DataFrame:
    """(other columns, pos, x) for each element of ``found``."""
    return captures.select(*[c for c in captures.columns if c != "payload"], F.posexplode(found).alias("pos", "x"))


def _first_of(df: DataFrame) -> DataFrame:
    """One branch for each external_id, the one that came first; rows without id, name or address are left out."""
    whole = df.filter("external_id IS NOT NULL AND name IS NOT NULL AND address IS NOT NULL")
    row = F.struct(*BRANCH[1:])
    return whole.groupBy("external_id").agg(F.min_by(row, F.struct("seq", "pos")).alias("r")).select("external_id", "r.*")


def _flyer(df: DataFrame, **columns) -> DataFrame:
    kinds = {"flyer_id": "long", "pages": "array<string>", "posted_at": "timestamp", "valid_until": "timestamp"}
    return df.select(*[columns.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in FLYER])


def _branch(df: DataFrame, **columns) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select("seq", "pos", *[columns.get(c, none).alias(c) for c in BRANCH])


# --- flyers --------------------------------------------------------------------------------------------------------


def cms_flyers(captures: DataFrame, host: str) -> DataFrame:
    """{"data": [{id, name, description, cover: {url}, pdf: {url}}]}: flyers with a cover; paths are made absolute on ``host``."""
    schema = "data array<struct<id long, name string, description string, cover struct<url string>, pdf struct<url string>>>"
    x = _items(captures, F.from_json("payload", schema)["data"]).filter("x.cover.url <> ''")

    def on_host(path: Column) -> Column:
        return F.when(path.rlike("^https?://"), path).otherwise(F.concat(F.lit(host + "/"), F.regexp_replace(path, "^/+", "")))

    pdf = F.nullif(F.col("x.pdf.url"), F.lit(""))
    own = {"name": F.trim(F.coalesce("x.name", F.lit(""))), "description": F.trim(F.coalesce("x.description", F.lit("")))}
    return _flyer(x, flyer_id=F.col("x.id"), cover_url=on_host(F.col("x.cover.url")), pdf_url=on_host(pdf), pages=_no_pages(), **own)


def _day(c: Column) -> Column:
    """A dd/mm/yyyy date's midnight, or null."""
    return F.when(F.trim(c).rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(F.trim(c), F.lit("dd/MM/yyyy")))


def covered_flyers(captures: DataFrame, slug: str, state: str, brand: str, now: Column, title: str = "Jornal de Ofertas") -> DataFrame:
    """{"lojas": [{nid, name, url}], "ofertas": [...]}: flyers for stores under /ofertas/<slug>/ that haven't ended. The
    description says whom a flyer is for: all stores of the state, all but the fewer, or only some."""
    schema = "lojas array<struct<nid long, name string, url string>>, ofertas array<struct<id_oferta long, title string, start_date string, end_date string, lojas array<struct<nid long>>, images array<struct<url string>>>>"
    p = captures.withColumn("p", F.from_json("payload", schema))
    own = F.filter("p.lojas", lambda s: s["url"].startswith(f"/ofertas/{slug}/") & (s["nid"] != 0))
    named = F.transform(own, lambda s: F.struct(s["nid"].alias("nid"), _unbrand(F.coalesce(_line(s["name"]), F.lit("")), brand).alias("name")))
    last = F.filter(named, lambda s, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["nid"] == s["nid"]))
    p = p.withColumn("names", F.coalesce(last, F.array().cast("array<struct<nid:bigint,name:string>>")))
    x = p.select("seq", "names", F.posexplode("p.ofertas").alias("pos", "x"))
    ids = F.coalesce(F.transform("x.lojas", lambda s: s["nid"]), F.array().cast("array<bigint>"))
    inside = F.filter("names", lambda s: F.array_contains(ids, s["nid"]))
    outside = F.filter("names", lambda s: ~F.array_contains(ids, s["nid"]))
    x = x.withColumns({"inside": inside, "outside": outside, "start": _day(F.col("x.start_date")), "end": _day(F.col("x.end_date"))})
    urls = F.filter(F.transform("x.images", lambda i: i["url"]), lambda u: u != "")
    x = x.withColumn("pages", urls).filter((F.size("inside") > 0) & (F.size("pages") > 0))
    x = x.filter(F.col("end").isNull() | (F.col("end") >= F.date_trunc("day", now)))
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda s: s["name"])), ", ")
    every = F.lit(f"Todas as lojas do {state}")
    scope = (
        F.when(F.size("outside") == 0, every)
        .when(F.size("outside") < F.size("inside"), F.concat(every, F.lit(", exceto: "), listed("outside")))
        .otherwise(F.concat(F.lit("Lojas: "), listed("inside")))
    )
    until = F.col("end") + F.expr("interval 23 hours 59 minutes 59 seconds")
    return _flyer(x, flyer_id=F.col("x.id_oferta"), name=F.coalesce(_text("x.title"), F.lit(title)), description=scope, cover_url=F.col("pages")[0], pages=F.col("pages"), posted_at=F.col("start"), valid_until=until)


def stamped_flyers(captures: DataFrame, base: str, now: Column) -> DataFrame:
    """{"status", "data": [{id_encarte, descricao, arquivo, inicio, validade}]}: flyers with a file that haven't ended."""
    schema = "status string, data array<struct<id_encarte long, descricao string, arquivo string, inicio string, validade string>>"
    p = F.from_json("payload", schema)
    x = _items(captures, F.when(p["status"] == "success", p["data"]))
    stamp = lambda c: F.try_to_timestamp(F.trim(c), F.lit("yyyy-MM-dd HH:mm:ss"))
    x = x.withColumns({"start": stamp("x.inicio"), "end": stamp("x.validade")}).filter("x.arquivo <> '' AND x.id_encarte <> 0")
    x = x.filter(F.col("end").isNull() | (F.col("end") >= now))
    quoted = F.url_encode("x.arquivo")
    for form, percent in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):  # a form's encoding, as a path's
        quoted = F.replace(quoted, F.lit(form), F.lit(percent))
    url = F.concat(F.lit(f"{base}/api-proxy.php?file="), quoted)
    return _flyer(x, flyer_id=F.col("x.id_encarte"), name=F.coalesce(_text("x.descricao"), F.lit("Encarte")), description=F.lit(""), cover_url=url, pdf_url=url, pages=_no_pages(), posted_at=F.col("start"), valid_until=F.col("end"))


def gallery_flyers(captures: DataFrame, galleries: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """[{id, date, link, title: {rendered}}] and the pages (link, html) they lead to: flyers posted within ``days``, with the
    images of their gallery in order, each once. A flyer whose page has none, or wasn't captured, is left out."""
    schema = "array<struct<id long, date string, link string, title struct<rendered string>>>"
    x = _items(captures, F.from_json("payload", schema)).select("x.*").withColumn("posted", F.col("date").try_cast("timestamp"))
    x = x.filter(F.col("posted") >= now - F.make_dt_interval(F.lit(days)))
    images = galleries.select("link", F.array_distinct(F.regexp_extract_all("html", F.lit(GALLERY_IMAGE), F.lit(1))).alias("pages")).filter(F.size("pages") > 0)
    x = x.join(images.groupBy("link").agg(F.min("pages").alias("pages")), "link")
    return _flyer(x, flyer_id=F.col("id"), name=html_text("title.rendered"), description=F.lit(""), cover_url=F.col("pages")[0], pages=F.col("pages"), posted_at=F.col("posted"))


def sided_flyers(captures: DataFrame) -> DataFrame:
    """HTML with one picture for each side ("Name – Frente", "Name – Verso", "Name - 2"): the sides of a name are the pages
    of one flyer, in the order of the page; what stands under the archive's heading is left out. The id is the name's crc32."""
    week = F.split_part("payload", F.lit(ARCHIVE), F.lit(1))
    titles, images = (F.regexp_extract_all(week, F.lit(FLYER_ITEM), F.lit(g)) for g in (1, 2))
    x = _items(captures, F.arrays_zip(titles.alias("title"), images.alias("src")))
    x = x.withColumn("name", F.trim(F.regexp_replace(html_text("x.title"), SIDE, "")))
    sides = F.array_sort(F.collect_list(F.struct("pos", F.col("x.src").alias("src"))))
    date = F.max(F.nullif(F.regexp_extract("x.src", FILE_DATE, 1), F.lit(""))).try_cast("timestamp")
    x = x.groupBy("seq", "name").agg(sides.alias("sides"), date.alias("posted"))
    pages = F.transform("sides", lambda s: s["src"])
    return _flyer(x, flyer_id=F.crc32("name"), name=F.col("name"), description=F.lit(""), cover_url=pages[0], pages=pages, posted_at=F.col("posted"))


def union_flyers(feeds: dict[str, DataFrame]) -> DataFrame:
    """All feeds in one form, with the chain each belongs to."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(chain).alias("chain"), *FLYER) for chain, df in feeds.items()])


# --- branches ------------------------------------------------------------------------------------------------------


def pickup_branches(captures: DataFrame) -> DataFrame:
    """{"items": [{pickupPoint: {id, friendlyName, isActive, address}}]}: active points with coordinates (longitude first)."""
    schema = "items array<struct<pickupPoint struct<id string, friendlyName string, isActive boolean, address struct<street string, number string, neighborhood string, city string, state string, geoCoordinates array<double>>>>>"
    x = _items(captures, F.transform(F.from_json("payload", schema)["items"], lambda i: i["pickupPoint"]))
    a = F.col("x.address")
    street = F.when(a["street"] != "", F.concat_ws(" ", F.trim(a["street"]), _text(a["number"])))
    label = F.nullif(F.concat_ws(", ", street, *[_text(a[c]) for c in ("neighborhood", "city", "state")]), F.lit(""))
    x = x.filter("x.isActive AND size(x.address.geoCoordinates) = 2 AND x.id <> ''")
    return _first_of(_branch(x, external_id=F.col("x.id"), name=_text("x.friendlyName"), address=label, latitude=a["geoCoordinates"][1], longitude=a["geoCoordinates"][0]))


def listed_branches(captures: DataFrame) -> DataFrame:
    """[{id, name, address}], bare or under "data"."""
    item = "array<struct<id string, name string, address string>>"
    x = _items(captures, F.coalesce(F.from_json("payload", f"data {item}")["data"], F.from_json("payload", item)))
    return _first_of(_branch(x, external_id=F.col("x.id"), name=_text("x.name"), address=_text("x.address")))


def located_branches(captures: DataFrame, prefix: str = "Loja ") -> DataFrame:
    """{"data": [{id, name, address, coordinates: "lat, lon"}]}: only those with two numbers; names without ``prefix``."""
    schema = "data array<struct<id string, name string, address string, coordinates string>>"
    x = _items(captures, F.from_json("payload", schema)["data"]).withColumn("c", F.split("x.coordinates", ","))
    number = lambda i: F.trim(F.col("c")[i]).try_cast("double")
    x = x.filter((F.size("c") == 2)).withColumns({"lat": number(0), "lon": number(1)}).filter("lat IS NOT NULL AND lon IS NOT NULL")
    return _first_of(_branch(x, external_id=F.col("x.id"), name=_unbrand(_text("x.name"), prefix), address=_text("x.address"), latitude=F.col("lat"), longitude=F.col("lon")))


def embedded_branches(captures: DataFrame, state: str, brand: str, bounds: tuple[float, float, float, float], marker: str = STORES_MARKER) -> DataFrame:
    """HTML whose script holds the stores as JSON after ``marker``: those of the state; a point outside its bounds (south,
    north, west, east) is dropped, the store stays."""
    schema = "array<struct<loja_id string, n string, lat string, lon string, logradouro string, complemento string, c string, uf string>>"
    rest = F.when(F.contains("payload", F.lit(marker)), F.substr("payload", F.position(F.lit(marker), F.col("payload")) + len(marker)))
    x = _items(captures, F.from_json(rest, schema)).filter(F.col("x.uf") == state)
    bare = lambda c: F.nullif(F.btrim(c, F.lit(" ,")), F.lit(""))
    street = bare("x.logradouro")
    address = F.when(street.isNotNull(), F.concat_ws(", ", street, bare("x.complemento"), _text("x.c"), F.col("x.uf")))
    lat, lon = F.col("x.lat").try_cast("double"), F.col("x.lon").try_cast("double")
    inside = lat.between(bounds[0], bounds[1]) & lon.between(bounds[2], bounds[3])
    return _first_of(_branch(x, external_id=F.nullif(F.col("x.loja_id"), F.lit("")), name=_unbrand(_line("x.n"), brand), address=address, latitude=F.when(inside, lat), longitude=F.when(inside, lon)))


def banner_branches(captures: DataFrame, banner: str, states: tuple[str, ...]) -> DataFrame:
    """[{tipo, estado, nome, endereco, bairro, cidade}] of several banners and states: one banner's, by name."""
    schema = "array<struct<tipo string, estado string, nome string, endereco string, bairro string, cidade string>>"
    x = _items(captures, F.from_json("payload", schema)).filter((F.trim("x.tipo") == banner) & F.trim("x.estado").isin(*states))
    part = lambda c: F.nullif(F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" -")), F.lit(""))
    address = F.nullif(F.concat_ws(", ", part("x.endereco"), part("x.bairro"), part("x.cidade")), F.lit(""))
    return _first_of(_branch(x, external_id=_text("x.nome"), name=_text("x.nome"), address=address))


def feed_address(text: Column, city: Column, state: str) -> Column:
    """Free text as a street address: without "City-State/" before it, remarks in brackets, the country and, on a highway, the
    postcode; city and state are added where the text doesn't say them. Null for nothing."""
    t = F.regexp_replace(text, rf"(?iU)^\s*[\w ]+\s*[-/]\s*{state}\s*[/-]\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\([^)]*\)", " "), r"(?iU)\bBrasil\b|\bBairro:\s*", " ")
    t = F.btrim(F.regexp_replace(F.replace(t, F.lit("–"), F.lit("-")), r"(?U)\s+", " "), F.lit(" .,-"))
    t = F.regexp_replace(t, r"[\s,]*,[\s,]*", ", ")
    t = F.when(t.rlike(rf"^(BR|{state})-\d+"), F.regexp_replace(t, r",?\s*\b\d{5}-?\d{3}\b", "")).otherwise(t)
    town = F.when(~F.contains(F.lower(t), F.lower(city)), city)
    full = F.when(t.rlike(rf"\b{state}\b"), t).otherwise(F.concat_ws(", ", t, _text(town), F.lit(state)))
    return F.when(t != "", full)


def city_branches(captures: DataFrame, code: str, brand: str, state: str) -> DataFrame:
    """Captures (seq, city, payload), one for each city: {"status", "data": [{idloja, marca, nome_exibicao, endereco}]}."""
    schema = "status string, data array<struct<idloja string, marca string, nome_exibicao string, endereco string>>"
    p = F.from_json("payload", schema)
    x = _items(captures, F.when(p["status"] == "success", p["data"])).filter((F.col("x.marca") == code) & (F.col("x.idloja") != ""))
    name = _line("x.nome_exibicao")
    rest = F.when(name.startswith(brand), _text(F.substr(name, F.lit(len(brand) + 1)))).otherwise(name)
    return _first_of(_branch(x, external_id=F.col("x.idloja"), name=rest, address=feed_address(F.col("x.endereco"), F.trim("city"), state)))


def _pattern_branches(captures: DataFrame, start: str, rest: str, prefix: str) -> DataFrame:
    """Branches of HTML: ``start`` begins each one's piece of the page, ``rest`` finds name and address within it."""
    text = F.col("payload")
    for entity, value in (("&nbsp;", " "), ("&#8211;", "–"), ("&ndash;", "–"), ("&amp;", "&"), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(value))
    x = _items(captures, F.split(text, f"(?={start})"))
    name, address = (_line(F.regexp_extract("x", start + rest, g)) for g in (1, 2))
    return _first_of(_branch(x, external_id=name, name=F.concat(F.lit(prefix), name), address=address))


def page_branches(captures: DataFrame, brand: str) -> DataFrame:
    """HTML pages with "Brand – Loja Name" and, in an element after it, an address that ends in a postcode."""
    start = rf"(?s)\Q{brand}\E\s*[–-]\s*Loja\s"
    return _pattern_branches(captures, start, r"+([^<]+?)\s*<.*?>\s*([^<]*?\d{5}-\d{3})\s*<", f"{brand.split()[0]} ")


def heading_branches(captures: DataFrame, brand: str) -> DataFrame:
    """HTML with a heading "Brand Name" and "Endereço:" below it."""
    return _pattern_branches(captures, rf"(?is)<h2[^>]*>\s*\Q{brand}\E\s", r"+([^<]+?)\s*</h2>.*?Endereço:</strong>\s*([^<]+?)\s*</p>", "")


# --- product cards -------------------------------------------------------------------------------------------------


def _parted(run: Column) -> Column:
    """The cards of a run of links to one product: a card ends where the first element around its link closes that holds a
    price, and the next one begins at the next link. Elements that are never closed keep their cards together."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"), F.lit("").alias("text"), F.array().cast("array<string>").alias("cards"))

    def step(s: Column, t: Column) -> Column:
        closing, opening = t.startswith("</"), t.startswith("<") & (F.length(t) > 1) & ~t.rlike(VOID)
        depth = s["depth"] + F.when(closing, -1).when(opening, 1).otherwise(0)
        text, out = F.concat(s["text"], t), closing & (depth < s["least"])
        state = lambda d, least, tx, cards: F.struct(d.alias("depth"), least.alias("least"), tx.alias("text"), cards.alias("cards"))
        return (
            F.when((s["text"] == "") & ~t.rlike('(?s)^<a\\b[^>]*href="/produto/'), s)
            .when(out & html_text(text).rlike(PRICE), state(F.lit(0), F.lit(0), F.lit(""), F.concat(s["cards"], F.array(text))))
            .otherwise(state(depth, F.when(out, depth).otherwise(s["least"]), text, s["cards"]))
        )

    last = lambda s: F.when(s["text"] == "", s["cards"]).otherwise(F.concat(s["cards"], F.array(s["text"])))
    return F.reduce(F.regexp_extract_all(run, F.lit(MARKUP), F.lit(0)), start, step, last)


def product_cards(captures: DataFrame) -> DataFrame:
    """item_id, name, price_cents, regular_cents, offer of product cards in HTML captures, each product once: its first card
    that has a name and a price, by (seq, place). The shortest link text is the name, else a picture's; the first price is the
    regular one; a lower deal price counts unless it is for buying several."""

    def read(card: Column) -> Column:
        links = F.filter(F.transform(F.regexp_extract_all(card, F.lit(CARD_LINK), F.lit(1)), html_text), lambda t: t != "")
        by_length = F.transform(links, lambda t, i: F.struct(F.length(t).alias("n"), i.alias("i"), t.alias("t")))
        picture = _text(F.regexp_extract(card, r'<img\b[^>]*\balt="([^"]*)"', 1))
        return F.struct(F.regexp_extract(card, '/produto/([^/"]+)', 1).alias("item_id"), F.coalesce(F.array_min(by_length)["t"], picture).alias("name"), html_text(card).alias("text"))

    # read before the cards become rows, so that a card's text is made once
    runs = F.regexp_extract_all("payload", F.lit(CARD), F.lit(0))
    cards = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(LINK_AFTER_PRICE), _parted(r)).otherwise(F.array(r))))
    x = _items(captures, F.transform(cards, read)).select("seq", "pos", "x.*")
    money = lambda pattern: parse_money(F.nullif(F.regexp_extract("text", pattern, 1), F.lit("")))
    x = x.select("seq", "pos", "item_id", "name", money(PRICE).alias("regular"), money(DEAL).alias("deal"), F.nullif(F.regexp_extract("text", OFFER, 0), F.lit("")).alias("offer"))
    several = F.coalesce(F.col("offer").rlike(f"(?i)^(?:{MULTI_BUY})$"), F.lit(False))
    cheaper = (F.col("deal") > 0) & ~several & (F.col("deal") < F.col("regular"))
    x = x.filter("regular IS NOT NULL AND name IS NOT NULL")
    row = F.struct("name", F.when(cheaper, F.col("deal")).otherwise(F.col("regular")).alias("price_cents"), F.when(cheaper, F.col("regular")).alias("regular_cents"), "offer")
    return x.groupBy("item_id").agg(F.min_by(row, F.struct("seq", "pos")).alias("r")).select("item_id", "r.*")


# --- captures made of the given tables ------------------------------------------------------------------------------

#: "Now" of the flyer feeds, amid their dates.
FLYER_NOW = "1997-06-01 12:00:00"
BOUNDS = (-3.9, -3.55, -38.7, -38.35)
PER_PAGE = 20


def _pages(rows: DataFrame, span: int) -> DataFrame:
    """(seq, items): rows (k, item, again) laid out in pages of ``span`` keys, ``item`` on its page and ``again``, where there is
    one, first on the next page."""
    page = F.floor(F.col("k") / span)
    copies = F.array(F.struct(page.alias("seq"), F.col("item").alias("text")), F.struct((page + 1).alias("seq"), F.col("again").alias("text")))
    x = rows.select("k", F.explode(copies).alias("c")).filter("c.text IS NOT NULL")
    grouped = x.groupBy(F.col("c.seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("k", F.col("c.text").alias("text")))).alias("items"))
    return grouped.select("seq", F.transform("items", lambda i: i["text"]).alias("items"))


def _laid(rows: DataFrame, span: int, before: str, between: str, after: str) -> DataFrame:
    return _pages(rows, span).select("seq", F.concat(F.lit(before), F.array_join("items", between), F.lit(after)).alias("payload"))


def _cat(*parts) -> Column:
    """Texts and columns joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def branch_feeds(spark, d) -> dict[str, DataFrame]:
    """Eight chains' branches, read from captures of their feeds; all branches are dealt to the chains by id."""
    b = branches(spark, d)
    k = F.col("id")
    rest = k % 3
    b = b.select(
        k.alias("k"), (k % 8).alias("feed"), rest.alias("rest"), "external_id", "name", "address", "latitude", "longitude",
        F.when(k % 5 == 0, "PI").otherwise("CE").alias("state"), _cat("Rua ", k % 97).alias("street"),
    )
    name, other, address, third = F.col("name"), _cat("Copy of ", F.col("name")), F.col("address"), F.col("rest") == 0
    lat, lon, ext, street, state = (F.col(c) for c in ("latitude", "longitude", "external_id", "street", "state"))

    def rows(feed: int, item) -> DataFrame:
        """Items of a feed, some again under another name on the next page."""
        return b.filter(F.col("feed") == feed).select("k", item(name).alias("item"), F.when(F.col("rest") == 1, item(other)).alias("again"))

    span = PER_PAGE * 8
    point = lambda n: _json(pickupPoint=F.struct(ext.alias("id"), n.alias("friendlyName"), (~third).alias("isActive"), F.struct(street.alias("street"), (F.col("k") % 999).cast("string").alias("number"), F.lit(" ").alias("neighborhood"), F.lit("Fortaleza").alias("city"), state.alias("state"), F.array(lon, lat).alias("geoCoordinates")).alias("address")))
    plain = lambda n: _json(id=F.col("k"), name=F.when(third, " ").otherwise(n), address=address)
    located = lambda n: _json(id=F.col("k"), name=_cat("Loja ", n), address=address, coordinates=F.when(third, "-3.7").otherwise(F.format_string("%.5f, %.5f", lat, lon)))
    embedded = lambda n: _json(loja_id=F.col("k"), n=_cat("Chain 3  ", n), lat=F.when(third, lat - 20).otherwise(lat).cast("string"), lon=lon, logradouro=_cat(street, ", "), complemento=F.lit(""), c=F.lit("Fortaleza"), uf=state)
    # the feed's key is the name, so what comes again differs in the address
    banner = b.filter("feed = 4").select(
        "k",
        _json(tipo=F.when(third, "Posto Chain 4").otherwise("Chain 4 "), estado=F.when(state == "CE", "Ceará").otherwise("Piauí"), nome=name, endereco=_cat(street, " - "), bairro=F.lit(" - "), cidade=F.lit("Fortaleza")).alias("item"),
        F.when(F.col("rest") == 1, _json(tipo=F.lit("Chain 4"), estado=F.lit("CE"), nome=F.when(state == "CE", name), endereco=F.lit("Outra"))).alias("again"),
    )
    city = lambda n: _json(idloja=F.col("k"), marca=F.when(third, "SM").otherwise("MA"), nome_exibicao=_cat("Chain 5 ", n), endereco=F.when(state == "CE", _cat("Fortaleza-Ce/ Bairro: Centro – ", street, " , 10 (fundos).")).otherwise(_cat("BR-116, 9800 - Messejana, ", street, ", 60821-000, Brasil")))
    listing = lambda text, again: b.filter(f"feed = {text[0]}").select("k", _cat(*text[1]).alias("item"), F.when(F.col("rest") == 1, _cat(*again)).alias("again"))
    one = listing((6, ("<h3>Chain Six &#8211; Loja ", name, "</h3><p> ", street, ",  10 - ", F.when(third, "sem").otherwise("60000-000"), " </p>")), ("<h3>Chain Six - Loja ", name, "</h3><p>Outra, 60000-001</p>"))
    two = listing((7, ("<h2 class=x> Chain Seven ", name, " </h2><p><strong>Endereço:</strong> ", address, " </p>")), ("<h2>Chain Seven ", name, "</h2><p><strong>Endereço:</strong> Outra</p>"))
    return {
        "Chain 0": pickup_branches(_laid(rows(0, point), span, '{"items": [', ",", "]}")),
        "Chain 1": listed_branches(_laid(rows(1, plain), span, '{"data": [', ",", "]}")),
        "Chain 2": located_branches(_laid(rows(2, located), span, '{"data": [', ",", "]}")),
        "Chain 3": embedded_branches(_laid(rows(3, embedded), span, '<script>x = {"assai": {"lojas":[', ",", "]}};</script>"), "CE", "Chain 3 ", BOUNDS),
        "Chain 4": banner_branches(_laid(banner, span, "[", ",", "]"), "Chain 4", ("Ceará", "CE")),
        "Chain 5": city_branches(_laid(rows(5, city), span, '{"status": "success", "data": [', ",", "]}").withColumn("city", F.lit("Fortaleza ")), "MA", "Chain 5 ", "CE"),
        "Chain 6": page_branches(_laid(one, span, "<html>", "\n", "</html>"), "Chain Six"),
        "Chain 7": heading_branches(_laid(two, span, "<html>", "\n", "</html>"), "Chain Seven"),
    }


def flyer_feeds(spark, d) -> dict[str, DataFrame]:
    """Five chains' flyers, read from captures of their feeds; all orders are dealt to the chains by key."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders").select(k.alias("k"), (k % 5).alias("feed"), at.alias("at"), F.floor(k / 5).alias("m"))
    k, m, at = F.col("k"), F.col("m"), F.col("at")
    now = F.lit(FLYER_NOW).cast("timestamp")
    title = _cat(" Encarte ", k, " ")
    none = F.lit(None).cast("string")

    def rows(feed: int, item: Column) -> DataFrame:
        return o.filter(F.col("feed") == feed).select("k", item.alias("item"), none.alias("again"))

    span = PER_PAGE * 5
    cover = F.when(m % 3 != 0, F.when(m % 4 == 0, _cat("https://img/", k, ".jpg")).otherwise(_cat("/up/", k, ".jpg")))
    cms = _json(id=k, name=title, description=_cat("até ", F.date_format(at, "dd/MM"), " "), cover=F.struct(cover.alias("url")), pdf=F.struct(F.when(m % 7 != 0, _cat("up/", k, ".pdf")).alias("url")))
    stores = ", ".join(f'{{"nid": {i}, "name": "Chain 1  Loja {i}", "url": "/ofertas/{"ceara" if i < 6 else "piaui"}/loja-{i}"}}' for i in range(1, 7))
    covers = F.transform(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda i: F.expr("m").bitwiseAND(F.pow(F.lit(2), i - 1).cast("long")) != 0), lambda i: F.struct(i.alias("nid")))
    images = F.when(m % 11 != 0, F.array(F.struct(_cat("p1-", k).alias("url")), F.struct(F.lit("").alias("url")), F.struct(_cat("p2-", k).alias("url"))))
    covered = _json(id_oferta=k, title=F.when(m % 2 == 0, title), start_date=F.date_format(at, "dd/MM/yyyy"), end_date=F.when(m % 13 == 0, "sem data").otherwise(F.date_format(at + F.expr("interval 500 days"), "dd/MM/yyyy")), lojas=covers, images=images)
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    stamped = _json(id_encarte=k, descricao=F.when(m % 2 == 0, title), arquivo=F.when(m % 9 != 0, _cat("up/enc ", k, ".pdf")), inicio=stamp(at), validade=F.when(m % 13 != 0, stamp(at + F.expr("interval 500 days"))))
    posts = _json(id=k, date=F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), link=_cat("https://x/", k), title=F.struct(_cat("<b>Encarte</b> &amp; ", k).alias("rendered")))
    image = lambda i: _cat('<a class="e-gallery-item x" href=" https://img/', k, f'-{i}.jpg"></a>')
    html = F.when(m % 4 != 0, F.concat(image(2), image(1), image(2))).otherwise("<p>vazio</p>")
    galleries = o.filter("feed = 3").select(_cat("https://x/", k).alias("link"), html.alias("html"))
    side = lambda label, i, days: _cat('<div class="offers__item"> <h3 class=t>Encarte ', k, label, '</h3> <img alt="" src="/', k, f"-{i}-", F.date_format(F.add_months(F.date_add(at, days), 120), "yyyy-MM-dd"), '.jpg"></div>')
    sided = F.when(m % 3 == 0, side("", 0, 0)).when(m % 3 == 1, F.concat(side(" – Frente", 0, 2), side(" – Verso", 1, 1))).otherwise(F.concat(side(" - 1", 0, 0), side(" - 2", 1, 1), side(" - 3", 2, 2)))
    archive = '<h2>Ofertas anteriores</h2><div class="offers__item"><h3>Encarte velho</h3><img src="/velho.jpg"></div>'
    return {
        "Chain 0": cms_flyers(_laid(rows(0, cms), span, '{"data": [', ",", "]}"), "https://cms"),
        "Chain 1": covered_flyers(_laid(rows(1, covered), span, f'{{"lojas": [{stores}], "ofertas": [', ",", "]}"), "ceara", "Ceará", "Chain 1 ", now),
        "Chain 2": stamped_flyers(_laid(rows(2, stamped), span, '{"status": "success", "data": [', ",", "]}"), "https://x", now),
        "Chain 3": gallery_flyers(_laid(rows(3, posts), span, "[", ",", "]"), galleries, now),
        "Chain 4": sided_flyers(_laid(rows(4, sided), span, "<html>", "\n", archive)),
    }


def _q_flyers(s, d):
    return union_flyers(flyer_feeds(s, d)).select("chain", "name", "description", "cover_url", "pdf_url", F.array_join("pages", " ").alias("pages"), "posted_at", "valid_until")


def _q_union(s, d):
    return union_flyers(flyer_feeds(s, d)).groupBy("chain").agg(F.count(F.lit(1)).alias("n_flyers"), F.sum(F.size("pages")).alias("n_pages"), F.max("posted_at").alias("newest"))


def _q_branches(s, d):
    feeds = branch_feeds(s, d)
    return reduce(DataFrame.unionByName, [df.select(F.lit(chain).alias("chain"), *BRANCH) for chain, df in feeds.items()])


def _q_cards(s, d):
    p = prices(s, d)
    order = F.floor(F.col("id") / (10 * 1_000_000 * 512))
    i, money = F.col("product_id"), lambda c: F.replace(F.format_string("%.2f", c), F.lit("."), F.lit(","))
    cents = F.round(F.col("price") * 100)
    link = lambda inner: _cat('<a class="c" href="/produto/', i, '/x">', inner, "</a>")
    deal = F.when(i % 5 == 0, _cat("<i>Leve 3 e pague 2</i> sai por R$ ", money(F.floor(cents / 2) / 100))).when(i % 5 == 1, _cat("<i>20% OFF</i> Sai por R$ ", money(F.floor(cents * 3 / 4) / 100))).when(i % 5 == 2, _cat("sai por R$ ", money(F.col("price") + 3))).otherwise("")
    card = F.concat(F.lit("<div>"), link(F.lit('<img src="x">')), link(_cat("P", i)), link(_cat("<b>P", i, "</b> R$")), _cat("<span>R$ ", money(F.col("price")), "</span>"), deal, F.lit("</div>"))
    again = F.concat(F.lit("<div>"), link(F.lit("Outro")), F.lit("<span>R$ 0,01</span></div>"))
    rows = p.select(F.col("id").alias("k"), card.alias("item"), F.lit(None).cast("string").alias("again"), order.alias("seq"), again.alias("clone"))
    page = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("k", "item", "clone"))).alias("cards"))
    html = F.concat(F.array_join(F.transform("cards", lambda c: c["item"]), "\n"), F.array_join(F.transform("cards", lambda c: c["clone"]), "\n"))
    return product_cards(page.select("seq", html.alias("payload")))


QUERIES = {"src_flyers": _q_flyers, "set_union_flyers": _q_union, "src_branches": _q_branches, "src_html_cards": _q_cards}

_FLYERS_SQL = f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS feed, o_orderkey // 5 AS m, o_orderdate::TIMESTAMP AS ts, date_trunc('day', o_orderdate::TIMESTAMP) AS day, TIMESTAMP '{FLYER_NOW}' AS now FROM orders),
 c AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda i: (m & (1 << (i - 1))::BIGINT) <> 0) AS have, list_filter([1, 2, 3, 4, 5], lambda i: (m & (1 << (i - 1))::BIGINT) = 0) AS lack FROM o WHERE feed = 1),
 f AS (SELECT 'Chain 0' AS chain, 'Encarte ' || k AS name, 'até ' || strftime(ts, '%d/%m') AS description, CASE WHEN m % 4 = 0 THEN 'https://img/' ELSE 'https://cms/up/' END || k || '.jpg' AS cover_url,
   CASE WHEN m % 7 <> 0 THEN 'https://cms/up/' || k || '.pdf' END AS pdf_url, '' AS pages, 0 AS n, NULL::TIMESTAMP AS posted_at, NULL::TIMESTAMP AS valid_until FROM o WHERE feed = 0 AND m % 3 <> 0
  UNION ALL SELECT 'Chain 1', CASE WHEN m % 2 = 0 THEN 'Encarte ' || k ELSE 'Jornal de Ofertas' END, CASE WHEN len(lack) = 0 THEN 'Todas as lojas do Ceará' WHEN len(lack) < len(have) THEN 'Todas as lojas do Ceará, exceto: ' || array_to_string(list_transform(lack, lambda i: 'Loja ' || i), ', ')
   ELSE 'Lojas: ' || array_to_string(list_transform(have, lambda i: 'Loja ' || i), ', ') END, 'p1-' || k, NULL, 'p1-' || k || ' p2-' || k, 2, day, CASE WHEN m % 13 <> 0 THEN day + INTERVAL 501 DAY - INTERVAL 1 SECOND END
   FROM c WHERE len(have) > 0 AND m % 11 <> 0 AND (m % 13 = 0 OR day + INTERVAL 500 DAY >= date_trunc('day', now))
  UNION ALL SELECT 'Chain 2', CASE WHEN m % 2 = 0 THEN 'Encarte ' || k ELSE 'Encarte' END, '', u, u, '', 0, ts, CASE WHEN m % 13 <> 0 THEN ts + INTERVAL 500 DAY END
   FROM (SELECT *, 'https://x/api-proxy.php?file=up%2Fenc%20' || k || '.pdf' AS u FROM o) WHERE feed = 2 AND m % 9 <> 0 AND (m % 13 = 0 OR ts + INTERVAL 500 DAY >= now)
  UNION ALL SELECT 'Chain 3', 'Encarte & ' || k, '', 'https://img/' || k || '-2.jpg', NULL, 'https://img/' || k || '-2.jpg https://img/' || k || '-1.jpg', 2, ts, NULL FROM o WHERE feed = 3 AND m % 4 <> 0 AND ts >= now - INTERVAL 14 DAY
  UNION ALL SELECT 'Chain 4', 'Encarte ' || k, '', string_split(g, ' ')[1], NULL, g, len(string_split(g, ' ')), CASE m % 3 WHEN 0 THEN day + INTERVAL 120 MONTH ELSE day + INTERVAL 2 DAY + INTERVAL 120 MONTH END, NULL FROM
   (SELECT *, CASE m % 3 WHEN 0 THEN p || '-0-' || strftime(day + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg' WHEN 1 THEN p || '-0-' || strftime(day + INTERVAL 2 DAY + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg ' || p || '-1-' || strftime(day + INTERVAL 1 DAY + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg'
     ELSE p || '-0-' || strftime(day + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg ' || p || '-1-' || strftime(day + INTERVAL 1 DAY + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg ' || p || '-2-' || strftime(day + INTERVAL 2 DAY + INTERVAL 120 MONTH, '%Y-%m-%d') || '.jpg' END AS g FROM (SELECT *, '/' || k AS p FROM o WHERE feed = 4)))"""

_B = "'Rua ' || (id % 97)"
ORACLE_SQL = {
    "src_flyers": f"{_FLYERS_SQL} SELECT chain, name, description, cover_url, pdf_url, pages, posted_at, valid_until FROM f",
    "set_union_flyers": f"{_FLYERS_SQL} SELECT chain, count(*) AS n_flyers, sum(n)::BIGINT AS n_pages, max(posted_at) AS newest FROM f GROUP BY 1",
    "src_branches": with_tables(
        f"""WITH b AS (SELECT *, id % 8 AS feed, id % 3 = 0 AS third, CASE WHEN id % 5 = 0 THEN 'PI' ELSE 'CE' END AS st FROM branches)
        SELECT 'Chain 0' AS chain, external_id, name, {_B} || ' ' || (id % 999) || ', Fortaleza, ' || st AS address, latitude, longitude FROM b WHERE feed = 0 AND NOT third
        UNION ALL SELECT 'Chain 1', id::VARCHAR, name, address, NULL, NULL FROM b WHERE feed = 1 AND NOT third
        UNION ALL SELECT 'Chain 2', id::VARCHAR, name, address, format('{{:.5f}}', latitude)::DOUBLE, format('{{:.5f}}', longitude)::DOUBLE FROM b WHERE feed = 2 AND NOT third
        UNION ALL SELECT 'Chain 3', id::VARCHAR, name, {_B} || ', Fortaleza, CE', CASE WHEN i THEN latitude END, CASE WHEN i THEN longitude END
          FROM (SELECT *, NOT third AND latitude BETWEEN {BOUNDS[0]} AND {BOUNDS[1]} AND longitude BETWEEN {BOUNDS[2]} AND {BOUNDS[3]} AS i FROM b) WHERE feed = 3 AND st = 'CE'
        UNION ALL SELECT 'Chain 4', name, name, {_B} || ', Fortaleza', NULL, NULL FROM b WHERE feed = 4 AND NOT third AND st = 'CE'
        UNION ALL SELECT 'Chain 5', id::VARCHAR, name, CASE WHEN st = 'CE' THEN 'Centro - ' || {_B} || ', 10, Fortaleza, CE' ELSE 'BR-116, 9800 - Messejana, ' || {_B} || ', Fortaleza, CE' END, NULL, NULL FROM b WHERE feed = 5 AND NOT third
        UNION ALL SELECT 'Chain 6', name, 'Chain ' || name, CASE WHEN third THEN NULL ELSE {_B} || ', 10 - 60000-000' END, NULL, NULL FROM b WHERE feed = 6 AND NOT third
        UNION ALL SELECT 'Chain 7', name, name, address, NULL, NULL FROM b WHERE feed = 7""",
        "branches",
    ),
    "src_html_cards": with_tables(
        """SELECT product_id::VARCHAR AS item_id, 'P' || product_id AS name, CASE WHEN product_id % 5 = 1 AND dc > 0 AND dc < c THEN dc ELSE c END AS price_cents, CASE WHEN product_id % 5 = 1 AND dc > 0 AND dc < c THEN c END AS regular_cents,
        CASE product_id % 5 WHEN 0 THEN 'Leve 3 e pague 2' WHEN 1 THEN '20% OFF' END AS offer FROM (SELECT product_id, id, round_even(price * 100, 0)::INT AS c, (round_even(price * 100, 0)::INT * 3) // 4 AS dc FROM prices
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY id) = 1)""",
        "prices",
    ),
}
