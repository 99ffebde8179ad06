"""Text of products: folding, sizes, categories, identity words, labels. All are Column expressions.

Regular expressions run on folded (ASCII, lower-case) text wherever they name word characters.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.sources.domain import branches, prices, products, stores, table, with_tables


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _base_letters() -> tuple[str, str]:
    """Latin letters whose canonical decomposition begins with one ASCII letter, and those letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column | str) -> Column:
    """Accents off, whether composed or as combining marks."""
    return F.regexp_replace(F.translate(_col(c), *_base_letters()), r"\p{M}", "")


def clean(c: Column | str) -> Column:
    """Lower case, no accents, single spaces."""
    return F.trim(F.regexp_replace(F.lower(strip_accents(c)), r"\s+", " "))


def words(c: Column | str) -> Column:
    """Words of the folded text (letters and digits)."""
    return F.regexp_extract_all(clean(c), F.lit(r"[a-z0-9]+"), F.lit(0))


# How sizes, packs and weighed goods are written.
SIZE = r"(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l)\b"
PACK = r"(\d+)\s*(?:unidades?|unid\.?|un\.?)\b"
WEIGHED = r"\bkg\b|\bquilo\b"


def parse_size(c: Column | str) -> Column:
    """struct(amount, unit, pack): grams, millilitres or units. One unit where the name tells no size."""
    text = clean(c)
    pack = F.regexp_extract(text, PACK, 1)
    pack = F.when(pack == "", 1).otherwise(F.least(F.lit(1000), F.coalesce(pack.try_cast("long"), F.lit(1000)))).cast("int")
    number = F.regexp_replace(F.regexp_extract(text, SIZE, 1), ",", ".").try_cast("double")
    unit = F.regexp_extract(text, SIZE, 2)
    amount = F.bround(number * F.when(unit.isin("kg", "l"), 1000).otherwise(1), 0)
    sized = amount.isNotNull() & (amount > 0) & (amount <= 1_000_000)
    weighed = text.rlike(WEIGHED)
    return F.struct(
        F.when(sized, amount.cast("int")).when(weighed, 1000).otherwise(1).alias("amount"),
        F.when(sized, F.when(unit.isin("kg", "g"), "g").otherwise("ml")).when(weighed, "g").otherwise("un").alias("unit"),
        pack.alias("pack"),
    )


def variable_weight(c: Column | str) -> Column:
    """Sold by weight: a bare kilo in the name makes the size."""
    size = parse_size(c)
    padded = F.concat(F.lit(" "), clean(c), F.lit(" "))
    return ((size["unit"] == "g") & (size["amount"] == 1000) & padded.contains(" kg")).cast("int")


# Words of a name that say nothing about which product it is.
NOT_IDENTITY = (
    "de", "da", "do", "das", "dos", "em", "e", "com", "sem", "para", "o", "a", "ao", "por", "tipo", "lata", "caixa", "pacote", "pct", "frasco",
    "garrafa", "pote", "sache", "tp", "unidade", "unidades", "un", "embalagem", "pack", "bandeja", "saco", "refil", "tubo", "vidro", "long", "neck",
    "cada", "gratis", "barra", "envoltorio", "glicerinado", "glicerina",
)


def match_tokens(c: Column | str) -> Column:
    """Sorted distinct words that identify a product, without size, pack, percentages and packaging."""
    text = F.regexp_replace(F.regexp_replace(clean(c), SIZE, " "), PACK, " ")
    found = F.regexp_extract_all(F.regexp_replace(text, r"\d+\s*%", " "), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in NOT_IDENTITY])))


# Category and its keywords, in order: within one word of a name the first keyword wins.
CATEGORIES = (
    ("Limpeza", (
        "sabao", "detergente", "lava", "desinfetante", "amaciante", "agua sanitaria", "limpador", "esponja", "lixo", "multiuso",
        "alvejante", "inseticida", "desodorizador", "tira manchas", "manchas", "limpa", "guardanapo", "saco", "vassoura", "rodo", "pano",
    )),
    ("Higiene e beleza", (
        "shampoo", "condicionador", "sabonete", "creme dental", "escova dental", "papel higienico", "desodorante", "absorvente",
        "fralda", "hidratante", "creme de tratamento", "espuma de barbear", "lenco umedecido", "enxaguante", "listerine", "hastes",
        "algodao", "fio dental", "mascara", "escova", "gel de banho", "barbeador", "cotonete", "protetor solar", "perfume",
    )),
    ("Bebidas", (
        "cerveja", "refrigerante", "suco", "agua", "vinho", "espumante", "whisky", "vodka", "energetico", "guarana", "cha",
        "isotonico", "licor", "gin", "cachaca", "tequila", "vermute", "rum", "champagne", "nectar", "bebida",
    )),
    ("Carnes e peixes", (
        "carne", "frango", "peito", "file", "bife", "linguica", "bacon", "salmao", "tilapia", "camarao", "hamburguer", "costela",
        "picanha", "coxa", "suino", "bovino", "empanado", "salsicha", "mortadela", "filezinho", "almondega", "bisteca", "lombo",
        "pernil", "alcatra", "patinho", "acem", "maminha", "fraldinha", "cupim", "peixe", "bacalhau", "sobrecoxa", "calabresa",
    )),
    ("Laticínios e frios", (
        "leite", "queijo", "iogurte", "requeijao", "manteiga", "margarina", "creme de leite", "presunto", "mussarela", "nata",
        "bebida lactea", "composto lacteo", "ovo", "ovos", "sorvete", "coalhada", "ricota", "peito de peru",
    )),
    ("Hortifruti", (
        "banana", "laranja", "batata", "tomate", "cebola", "alface", "cenoura", "melancia", "manga", "abacaxi", "uva", "maca",
        "limao", "abobora", "abobrinha", "alho", "mamao", "melao", "pera", "beterraba", "pimentao", "abacate", "ameixa", "chuchu",
        "goiaba", "kiwi", "maracuja", "morango", "frutas", "mexerica", "tangerina", "repolho", "brocolis", "couve", "pepino",
    )),
    ("Padaria e biscoitos", (
        "pao", "biscoito", "bolo", "torrada", "bolacha", "bisnaguinha", "brioche", "bolinho", "croissant", "rosca", "cookie",
    )),
    ("Mercearia", (
        "arroz", "feijao", "cafe", "acucar", "oleo", "azeite", "macarrao", "molho", "farinha", "sal", "achocolatado", "cereal",
        "granola", "aveia", "maionese", "ketchup", "chocolate", "bombom", "salgadinho", "tempero", "lasanha", "espaguete",
        "spaghetti", "massa", "penne", "talharim", "nhoque", "lamen", "miojo", "pizza", "mel", "geleia", "tapioca", "amendoim",
        "doce", "gelatina", "bala", "balas", "tortilha", "cappuccino", "atum", "sardinha", "milho", "ervilha", "marshmallow",
        "pasta de amendoim", "ghee", "vinagre", "mostarda", "sopa", "fermento", "leite condensado", "castanha",
    )),
)
# Keywords too general to name a kind within their category.
GENERAL = ("carne", "bovino", "suino", "peixe", "bebida")


def _keywords(categories) -> list[tuple[str, str, int]]:
    return [(c, k, i) for i, (c, k) in enumerate((c, k) for c, ks in categories for k in ks)]


def _word_pattern(keywords: list[str]) -> str:
    """At a word: the first keyword that it is, or from five letters that it begins with."""
    return "^(" + "|".join(k if len(k) >= 5 else k + r"(?![a-z0-9])" for k in keywords) + ")"


def with_category(df: DataFrame, name: str = "name", categories=CATEGORIES, general: tuple[str, ...] = GENERAL) -> DataFrame:
    """``df`` with category ("Outros" if no keyword fits) and subcategory ("" if only a general keyword does).

    A phrase at the start decides; else the first of three words that is a keyword; else the first keyword anywhere. A
    flavour ("sabor uva") doesn't count. A general keyword gives way to the next specific one of its category. A word is
    met with all keywords in one pattern, in their order, so a row costs a few matches rather than a loop over the table.
    """
    rows = _keywords(categories)
    every = F.array(*[F.lit(k) for _, k, _ in rows])
    single, phrases = [k for _, k, _ in rows if " " not in k], [k for _, k, _ in rows if " " in k]
    text = F.trim(F.regexp_replace(clean(name), r"\bsabor\s+\w+", " "))
    out = df.withColumn("_text", text).withColumn("_words", F.regexp_extract_all("_text", F.lit("[a-z0-9]+"), F.lit(0)))
    none = lambda c: F.nullif(c, F.lit(""))

    def anywhere(words: list[str], whole: list[str]) -> Column:
        """The first of these keywords that stands anywhere."""
        found = F.transform("_words", lambda w: F.regexp_extract(w, _word_pattern(words), 1)) if words else F.array().cast("array<string>")
        there = F.array(*[F.when(F.col("_text").contains(k), k) for k in whole]) if whole else F.array().cast("array<string>")
        known = F.filter(F.concat(found, there), lambda k: k.isNotNull() & (k != ""))
        return F.get(every, (F.array_min(F.transform(known, lambda k: F.array_position(every, k))) - 1).cast("int"))

    at_start = none(F.regexp_extract("_text", "^(" + "|".join(phrases) + ")", 1)) if phrases else F.lit(None)
    early = [none(F.regexp_extract(F.coalesce(F.get("_words", F.lit(i)), F.lit("")), _word_pattern(single), 1)) for i in range(3)]
    out = out.withColumn("_hit", F.coalesce(at_start, *early, anywhere(single, phrases)))
    category = F.lit("Outros")
    specific = F.lit(None).cast("string")
    for c, ks in categories:
        category = F.when(F.col("_hit").isin(*ks), c).otherwise(category)
        if set(ks) & set(general):
            named = [k for k in ks if k not in general]
            specific = F.when(F.col("_hit").isin(*ks), anywhere([k for k in named if " " not in k], [k for k in named if " " in k])).otherwise(specific)
    keyword = F.when(F.col("_hit").isin(*general), specific).otherwise(F.col("_hit"))
    out = out.withColumns({"category": category, "subcategory": F.coalesce(label(keyword), F.lit(""))})
    return out.drop("_text", "_words", "_hit")


# Words that stay in lower case, and acronyms that stay in capitals, in a title.
SMALL = (
    "de", "da", "do", "das", "dos", "e", "com", "sem", "para", "em", "ao", "aos", "a", "o", "no", "na", "por", "ou",
)
ACRONYMS = (
    "uht", "pet", "pvc", "led", "uv", "ph", "tv", "spf",
)


def label(keyword: Column | str) -> Column:
    """A keyword as a title; small words after the first stay lower."""
    parts = F.split(_col(keyword), " ")
    return F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & w.isin(*SMALL), w).otherwise(F.initcap(w))), " ")


def display_name(c: Column | str) -> Column:
    """Single-spaced; titled when over 70 % of its letters are capitals; sizes always in lower case."""
    text = F.trim(F.regexp_replace(F.coalesce(_col(c), F.lit("")), r"\s+", " "))
    letters, capitals = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), F.length(F.regexp_replace(text, r"[^\p{Lu}]", ""))
    shouting = (letters > 0) & (capitals * 10 > letters * 7)
    size = r"(?i)^(?:\d+(?:[.,]\d+)?(?:kg|g|mg|l|ml|un|und|cm|m)|\d+x\d+(?:[.,]\d+)?(?:kg|g|ml|l)?)$"

    def one(w: Column, i: Column) -> Column:
        low = F.lower(w)
        # capitals after any character that isn't a letter, so that "a/b" reads "A/B"
        title = F.array_join(F.transform(F.split(low, r"(?<=[^\p{L}])(?=\p{L})"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1_000_000))), "")
        return F.when(w.rlike(size), low).when(~shouting, w).when(low.isin(*ACRONYMS), F.upper(w)).when((i > 0) & low.isin(*SMALL), low).otherwise(title)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


# Portuguese words without content.
STOP = (
    "com", "sem", "para", "por", "dos", "das", "nos", "nas", "que", "uma", "uns", "umas", "aos", "pelo", "pela", "seu", "sua", "mais", "tipo",
)


def html_text(c: Column | str) -> Column:
    """Markup off, the common entities resolved, one line."""
    text = F.regexp_replace(_col(c), r"<[^>]+>", " ")
    for entity, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(value))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def content_words(c: Column | str) -> Column:
    """Distinct folded words of three letters or more that carry content, markup removed; sorted."""
    found = F.regexp_extract_all(clean(html_text(c)), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP])))


# Short forms that receipts print, with the word each stands for.
ABBREVIATIONS = {
    "bco": "branco", "qj": "queijo", "qjo": "queijo", "ref": "refrigerante", "refri": "refrigerante", "refrig": "refrigerante",
    "beb": "bebida", "fgo": "frango", "pres": "presunto", "mac": "macarrao", "sh": "shampoo", "shamp": "shampoo",
    "cond": "condicionador", "ach": "achocolatado", "achoc": "achocolatado", "desn": "desnatado", "integ": "integral",
    "gde": "grande", "pq": "pequeno", "pcte": "pacote", "tradic": "tradicional",
}


# Words of a receipt line that say nothing, and how packs and sizes without a unit are printed.
FILLERS = ("de", "da", "do", "das", "dos", "e", "com", "sem", "para", "tipo", "un", "und", "unid", "kg", "pct", "cx")
MULTI = r"\b(\d+)\s*x\s*(\d+(?:[.,]\d+)?)\s*(kg|g|ml|l)\b"
BARE_SIZE = r"[a-z](\d{3,4})(?!\d)"


def name_tokens(c: Column | str) -> Column:
    """Words of a receipt line that identify a product, as printed: the first pack and size off, numbers of three digits
    or more parted from letters, short forms spelled out, fillers, single letters and bare numbers dropped."""
    text = F.regexp_replace(clean(c), "(?s)^(.*?)" + MULTI, "$1 ")
    text = F.regexp_replace(text, "(?s)^(.*?)" + SIZE, "$1 ")
    text = F.regexp_replace(F.regexp_replace(text, r"([a-z])(\d{3,})", "$1 $2"), r"(\d{3,})([a-z])", "$1 $2")
    forms = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    spelled = F.transform(F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.coalesce(forms[w], w))
    return F.filter(spelled, lambda w: (F.length(w) >= 2) & ~w.rlike(r"^\d+$") & ~w.isin(*FILLERS))


def receipt_size(c: Column | str) -> Column:
    """struct(amount, unit, packs) of a receipt line; unit null for a bare number glued to a word, all null if none."""
    text = clean(c)
    number = lambda x: F.regexp_replace(x, ",", ".").try_cast("double")
    base = lambda n, u: F.bround(n * F.when(u.isin("kg", "l"), 1000).otherwise(1), 0).cast("int")
    unit = lambda u: F.when(u.isin("kg", "g"), "g").otherwise("ml")
    many, one = text.rlike(MULTI), text.rlike(SIZE)
    m, s = (lambda i: F.regexp_extract(text, MULTI, i)), (lambda i: F.regexp_extract(text, SIZE, i))
    return F.struct(
        F.when(many, base(number(m(2)), m(3))).when(one, base(number(s(1)), s(2))).otherwise(F.regexp_extract(text, BARE_SIZE, 1).try_cast("int")).alias("amount"),
        F.when(many, unit(m(3))).when(one, unit(s(2))).alias("unit"),
        F.when(many, m(1).try_cast("int")).when(one | text.rlike(BARE_SIZE), 1).alias("packs"),
    )


SIZE_WORD = r"(?i)\b\d+(?:[.,]\d+)?\s*(?:kg|g|ml|l|un(?:idades?)?)\b"


def sizeless_name(c: Column | str) -> Column:
    """The name without any size; never empty."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(_col(c), SIZE_WORD, " "), r"\s+", " "))
    return F.coalesce(F.nullif(rest, F.lit("")), F.trim(_col(c)))


# How readers of images mistake an O for a zero and one kilo for a word.
ZERO_AS_O = r"(?<=\d)O(?=\d|\s?(?:g|kg|ml|L)\b)"
ONE_KILO = r"(?U)(?<![\w.,])[1IlJj|]\s?k[gqo0](?![\w])"


def fix_units(c: Column | str) -> Column:
    """Sizes that readers of images mistake, put right; real sizes and words stay."""
    return F.regexp_replace(F.regexp_replace(_col(c), ZERO_AS_O, "0"), ONE_KILO, "1kg")


# Words that say what a shop is, not which chain it is.
SHOP_WORDS = (
    r"\b(supermercados?|supermercadinhos?|mercadinhos?|mercados?|mercadao|hipermercados?|super|atacadista|atacado|"
    r"loja|filial|unidade|express|ltda|eireli|sa|e|do|da|de|dos|das)\b"
)
# Complements of an address.
COMPLEMENT = r"(?i)\b(loja[\s-]*[\w\d]*|s\s*/\s*n|km\s*\d+|bloco\s*[\w\d]*|sala\s*[\w\d]*)\b"


def chain_key(c: Column | str) -> Column:
    """What identifies a chain in a shop's name: no bracketed part, branch after " - ", apostrophes or general words."""
    text = F.lower(strip_accents(F.translate(_col(c), "–—", "--")))
    text = F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F]", ""), r"\([^)]*\)", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)\s-\s.*$", ""), r"['`]", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[^a-z0-9]+", " "), SHOP_WORDS, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def address_clean(c: Column | str) -> Column:
    """An address without complements, single-spaced."""
    text = F.replace(F.regexp_replace(_col(c), COMPLEMENT, " "), F.lit(" ,"), F.lit(","))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def when_label(at: Column, now: Column, zone: str = "America/Fortaleza") -> Column:
    """A time (UTC) in words: today, yesterday or the day, and the hour, as people at ``zone`` read them."""
    local, today = F.from_utc_timestamp(at, zone), F.to_date(F.from_utc_timestamp(now, zone))
    hour = F.concat(F.lit(" às "), F.date_format(local, "HH:mm"))
    day = F.to_date(local)
    return F.when(at.isNull(), "em data não informada").when(day == today, F.concat(F.lit("hoje"), hour)).when(day == F.date_sub(today, 1), F.concat(F.lit("ontem"), hour)).otherwise(F.concat(F.lit("em "), F.date_format(local, "dd/MM"), hour))


def query_words(query: Column, least: int = 2, most: int = 60, words_at_most: int = 6) -> Column:
    """The folded words of a typed search, ``words_at_most`` of them; none where its length is out of bounds."""
    text = clean(query)
    found = F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))
    return F.when(F.length(text).between(least, most), F.slice(found, 1, words_at_most)).otherwise(F.array().cast("array<string>"))


def decimal_text(c: Column) -> Column:
    """A number with up to three places, comma for the decimal point and dots between thousands."""
    fixed = F.format_number(c.cast("double"), 3)
    plain = F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    return F.translate(plain, ",.", ".,")


def size_label(amount: Column, unit: Column) -> Column:
    big = amount >= 1000
    text = lambda suffix_big, suffix: F.when(big, F.concat(decimal_text(amount / 1000), F.lit(suffix_big))).otherwise(F.concat(decimal_text(amount), F.lit(suffix)))
    units = F.when(amount == 1, "1 unidade").otherwise(F.concat(decimal_text(amount), F.lit(" unidades")))
    return F.when(unit == "g", text(" kg", " g")).when(unit == "ml", text(" L", " ml")).otherwise(units)


def known_size(amount: Column, unit: Column, pack: Column) -> Column:
    return ~((unit == "un") & (amount * pack == 1))


def pack_label(amount: Column, unit: Column, pack: Column) -> Column:
    single = size_label(amount, unit)
    many = F.when(pack > 1, F.concat(pack.cast("string"), F.lit(" × "), single)).otherwise(single)
    return F.when(~known_size(amount, unit, pack), "Tamanho não informado").when(unit == "un", size_label(amount * pack, unit)).otherwise(many)


def list_name(name: Column, brand: Column, amount: Column, unit: Column, pack: Column) -> Column:
    """Name, brand and pack, the last two only where the name lacks them."""
    brand = F.when((F.coalesce(brand, F.lit("")) != "") & ~F.lower(name).contains(F.lower(brand)), brand)
    size = F.when(known_size(amount, unit, pack) & ~name.rlike(r"[0-9]"), pack_label(amount, unit, pack))
    return F.concat_ws(" · ", name, brand, size)


def condition_label(club: Column, coupon: Column, min_quantity: Column, limit: Column, payment: Column, note: Column) -> Column:
    """What a price asks of the buyer."""
    named = F.when(club.rlike("(?i)clube"), club).otherwise(F.concat(F.lit("Clube "), club))
    who = F.when(club.isNull() | (club == ""), None).when(clean(club) == "clube", "Só para membros do clube da loja").otherwise(F.concat(F.lit("Só para membros do "), named))
    text = F.concat_ws(
        " · ",
        who,
        F.when(F.coalesce(coupon, F.lit("")) != "", F.concat(F.lit("Exige cupom "), coupon)),
        F.when(min_quantity > 1, F.concat(F.lit("Levando "), min_quantity.cast("string"), F.lit(" un. ou mais"))),
        F.when(limit.isNotNull(), F.concat(F.lit("Limite de "), limit.cast("string"), F.lit(" por cliente"))),
        F.when(F.coalesce(payment, F.lit("")) != "", F.concat(F.lit("Pagamento: "), payment)),
        F.nullif(note, F.lit("")),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("Sem condição especial"))


def stock_note(stock: Column) -> Column:
    n = F.floor(stock)
    return F.when(stock > 0, F.concat(F.lit("Estoque informado pela loja: "), F.translate(F.format_number(n, 0), ",", "."), F.when(n == 1, " unidade").otherwise(" unidades")))


def club_of(offer: Column | str) -> Column:
    """The club named in a deal label, null if none."""
    return F.nullif(F.regexp_extract(_col(offer), r"(?iU)(\w*clube\w*)", 1), F.lit(""))


def _named(spark, sf_dir):
    return products(spark, sf_dir).select("id", "name", "brand")


def _per_name(name: str, function):
    def query(spark, sf_dir):
        return _named(spark, sf_dir).select("id", function(F.col("name")).alias(name))

    return query


_CLEAN = "trim(regexp_replace(lower(strip_accents({0})), '\\s+', ' ', 'g'))"


def clean_sql(x: str) -> str:
    return _CLEAN.format(x)


def size_sql(x: str) -> str:
    """DuckDB: struct(amount, unit, pack) of an expression."""
    t = clean_sql(x)
    return f"""(SELECT CASE WHEN a > 0 AND a <= 1000000 THEN {{'amount': a::INT, 'unit': CASE WHEN u IN ('kg', 'g') THEN 'g' ELSE 'ml' END, 'pack': p}}
        WHEN w THEN {{'amount': 1000, 'unit': 'g', 'pack': p}} ELSE {{'amount': 1, 'unit': 'un', 'pack': p}} END
      FROM (SELECT round_even(try_cast(replace(regexp_extract({t}, '{SIZE}', 1), ',', '.') AS DOUBLE) * CASE WHEN regexp_extract({t}, '{SIZE}', 2) IN ('kg', 'l') THEN 1000 ELSE 1 END, 0) AS a,
        regexp_extract({t}, '{SIZE}', 2) AS u, regexp_matches({t}, '{WEIGHED}') AS w,
        CASE WHEN regexp_extract({t}, '{PACK}', 1) = '' THEN 1 ELSE least(1000, regexp_extract({t}, '{PACK}', 1)::BIGINT)::INT END AS p))"""


def tokens_sql(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in NOT_IDENTITY)
    return f"""list_sort(list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace({clean_sql(x)}, '{SIZE}', ' ', 'g'), '{PACK}', ' ', 'g'), '\\d+\\s*%', ' ', 'g'), '[a-z0-9]+')), lambda w: w NOT IN ({stop})))"""


def category_sql(source: str = "products") -> str:
    """DuckDB: id, category, subcategory of ``source``(id, name), by joining words and keywords."""
    rows = ", ".join(f"({i}, '{c}', '{k}')" for c, k, i in _keywords(CATEGORIES))
    general = ", ".join(f"'{g}'" for g in GENERAL)
    small = ", ".join(f"'{w}'" for w in SMALL)
    hits = "w.w = k.keyword OR (length(k.keyword) >= 5 AND starts_with(w.w, k.keyword))"
    return f"""kw(rank, category, keyword) AS (VALUES {rows}),
tx AS (SELECT id, trim(regexp_replace({clean_sql("name")}, '\\bsabor\\s+\\w+', ' ', 'g')) AS t FROM {source}),
ws AS (SELECT id, unnest(regexp_extract_all(t, '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(t, '[a-z0-9]+'), 1) AS i FROM tx),
hit AS (SELECT id, 1 AS stage, 0 AS place, rank, category, keyword FROM tx JOIN kw k ON contains(keyword, ' ') AND starts_with(t, keyword)
  UNION ALL SELECT id, 2, i, rank, category, keyword FROM ws w JOIN kw k ON NOT contains(keyword, ' ') AND i <= 3 AND ({hits})
  UNION ALL SELECT id, 3, 0, rank, category, keyword FROM ws w JOIN kw k ON NOT contains(keyword, ' ') AND ({hits})
  UNION ALL SELECT id, 3, 0, rank, category, keyword FROM tx JOIN kw k ON contains(keyword, ' ') AND contains(t, keyword)),
best AS (SELECT id, arg_min(category, (stage, place, rank)) AS category, arg_min(keyword, (stage, place, rank)) AS keyword FROM hit GROUP BY id),
spec AS (SELECT h.id, arg_min(h.keyword, h.rank) AS keyword FROM hit h JOIN best b ON b.id = h.id AND b.category = h.category
  WHERE h.keyword NOT IN ({general}) GROUP BY h.id),
cat AS (SELECT tx.id, coalesce(b.category, 'Outros') AS category, coalesce(array_to_string(list_transform(string_split(
  CASE WHEN b.keyword IN ({general}) THEN s.keyword ELSE b.keyword END, ' '), lambda w, i: CASE WHEN i > 1 AND w IN ({small}) THEN w ELSE upper(w[1]) || w[2:] END), ' '), '') AS subcategory
  FROM tx LEFT JOIN best b USING (id) LEFT JOIN spec s ON s.id = tx.id)"""


def _q_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", clean("text").alias("clean"))


def _q_size(spark, sf_dir):
    return _named(spark, sf_dir).withColumn("s", parse_size("name")).select("id", "s.amount", "s.unit", "s.pack")


def _q_category(spark, sf_dir):
    return with_category(_named(spark, sf_dir)).select("id", "category")


def _q_subcategory(spark, sf_dir):
    return with_category(_named(spark, sf_dir)).select("id", "subcategory")


def _q_receipt_size(spark, sf_dir):
    return _named(spark, sf_dir).withColumn("s", receipt_size("name")).select("id", "s.amount", "s.unit", "s.packs")


def _q_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(content_words("html"), " ").alias("words"))


def _q_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html_text("html").alias("text"))


def _q_labels(function):
    def query(spark, sf_dir):
        d = _named(spark, sf_dir).withColumn("s", parse_size("name"))
        return d.select("id", function(d).alias("label"))

    return query


def _q_conditions(spark, sf_dir):
    p, k = prices(spark, sf_dir), F.col("id")
    return p.select("id", condition_label(club_of("offer"), F.when(k % 3 == 0, "C10"), (k % 4).cast("int"), F.when(k % 5 == 0, (k % 7 + 1).cast("int")), F.when(k % 6 == 0, "Pix"), F.when(k % 8 == 0, "Só loja").otherwise("")).alias("label"))


def _q_chain_key(spark, sf_dir):
    s, k = stores(spark, sf_dir), F.col("id")
    kind = F.when(k % 4 == 0, "Supermercado ").when(k % 4 == 1, "SUPER ").when(k % 4 == 2, "Mercadinho Pão d'").otherwise("")
    tail = F.when(k % 3 == 0, " (Centro)").when(k % 3 == 1, " – Loja 2").otherwise(" Atacadista Ltda")
    return s.select("id", chain_key(F.concat(kind, F.col("name"), tail)).alias("key"))


def _q_address(spark, sf_dir):
    b, k = branches(spark, sf_dir), F.col("id")
    more = F.when(k % 4 == 0, ", S/N").when(k % 4 == 1, F.concat(F.lit(" LOJA "), (k % 30).cast("string"))).when(k % 4 == 2, ", Bloco B, sala 3").otherwise(", km 19")
    return b.select("id", address_clean(F.concat(F.col("address"), more, F.lit(", Brasil"))).alias("address"))


def _q_when(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", when_label(F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")), F.lit("2024-01-15 12:00:00").cast("timestamp")).alias("label"))


def _q_query_words(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(query_words("text"), " ").alias("words"))


def _q_stock(spark, sf_dir):
    return prices(spark, sf_dir).select("id", stock_note(F.col("stock") * 100).alias("note"))


def _q_club(spark, sf_dir):
    return prices(spark, sf_dir).select("id", club_of("offer").alias("club"))


def _q_fix_units(spark, sf_dir):
    read = F.regexp_replace(F.regexp_replace("name", "0(?=[0-9]|g|ml)", "O"), " Kg$", " Jko")
    return _named(spark, sf_dir).select("id", fix_units(read).alias("fixed"))


QUERIES = {
    "fn_clean": _q_clean,
    "fn_parse_size": _q_size,
    "fn_variable_weight": _per_name("variable", variable_weight),
    "fn_categorize": _q_category,
    "fn_subcategorize": _q_subcategory,
    "fn_display_name": _per_name("shown", display_name),
    "fn_match_tokens": _per_name("tokens", lambda c: F.array_join(match_tokens(c), "|")),
    "fn_words": _q_words,
    "fn_html_text": _q_html,
    "fn_name_tokens": _per_name("tokens", lambda c: F.array_join(name_tokens(c), "|")),
    "fn_receipt_size": _q_receipt_size,
    "fn_sizeless_name": _per_name("name", sizeless_name),
    "fn_fix_units": _q_fix_units,
    "fn_chain_key": _q_chain_key,
    "fn_address_clean": _q_address,
    "fn_size_label": _q_labels(lambda d: size_label(d["s.amount"], d["s.unit"])),
    "fn_pack_label": _q_labels(lambda d: pack_label(d["s.amount"], d["s.unit"], d["s.pack"])),
    "fn_list_name": _q_labels(lambda d: list_name(F.col("name"), F.col("brand"), d["s.amount"], d["s.unit"], d["s.pack"])),
    "fn_condition_label": _q_conditions,
    "fn_stock_note": _q_stock,
    "fn_when_label": _q_when,
    "flt_query_words": _q_query_words,
    "fn_club": _q_club,
}

_DEC = "replace(replace(replace(regexp_replace(regexp_replace(format('{{:,.3f}}', ({0})::DOUBLE), '0+$', ''), '\\.$', ''), ',', '_'), '.', ','), '_', '.')"
_SIZE_LABEL = f"""CASE WHEN s.unit = 'g' THEN CASE WHEN {{a}} >= 1000 THEN {_DEC.format('{a} / 1000')} || ' kg' ELSE {_DEC.format('{a}')} || ' g' END
 WHEN s.unit = 'ml' THEN CASE WHEN {{a}} >= 1000 THEN {_DEC.format('{a} / 1000')} || ' L' ELSE {_DEC.format('{a}')} || ' ml' END
 WHEN {{a}} = 1 THEN '1 unidade' ELSE {_DEC.format('{a}')} || ' unidades' END""".replace("{:,.3f}", "{{:,.3f}}")
_SL = _SIZE_LABEL.format(a="s.amount")
_PL = f"CASE WHEN s.unit = 'un' AND s.amount * s.pack = 1 THEN 'Tamanho não informado' WHEN s.unit = 'un' THEN {_SIZE_LABEL.format(a='(s.amount * s.pack)')} WHEN s.pack > 1 THEN s.pack || ' × ' || {_SL} ELSE {_SL} END"
_SIZED = f"SELECT *, {size_sql('name')} AS s FROM products"
_HTML = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"

ORACLE_SQL = {
    "fn_clean": f"SELECT doc_id, {clean_sql('text')} AS clean FROM documents",
    "fn_parse_size": with_tables(f"SELECT id, s.amount AS amount, s.unit AS unit, s.pack AS pack FROM ({_SIZED})", "products"),
    "fn_variable_weight": with_tables(f"SELECT id, (s.unit = 'g' AND s.amount = 1000 AND contains(' ' || {clean_sql('name')} || ' ', ' kg'))::INT AS variable FROM ({_SIZED})", "products"),
    "fn_categorize": with_tables(f"WITH {category_sql()} SELECT id, category FROM cat", "products"),
    "fn_subcategorize": with_tables(f"WITH {category_sql()} SELECT id, subcategory FROM cat", "products"),
    "fn_match_tokens": with_tables(f"SELECT id, array_to_string({tokens_sql('name')}, '|') AS tokens FROM products", "products"),
    "fn_html_text": f"SELECT page_id, {_HTML.format('html')} AS text FROM pages",
    "fn_words": f"""SELECT page_id, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all({clean_sql(_HTML.format('html'))}, '[a-z0-9]{{3,}}')),
        lambda w: w NOT IN ({", ".join(f"'{w}'" for w in STOP)}))), ' ') AS words FROM pages""",
    "fn_sizeless_name": with_tables(f"""SELECT id, coalesce(nullif(trim(regexp_replace(regexp_replace(name, '{SIZE_WORD}', ' ', 'g'), '\\s+', ' ', 'g')), ''), trim(name)) AS name FROM products""", "products"),
    "fn_receipt_size": with_tables(f"""SELECT id, CASE WHEN m <> '' THEN round_even(try_cast(replace(ma, ',', '.') AS DOUBLE) * CASE WHEN mu IN ('kg', 'l') THEN 1000 ELSE 1 END, 0)::INT WHEN a IS NULL THEN try_cast(nullif(g, '') AS INT) ELSE round_even(a * CASE WHEN u IN ('kg', 'l') THEN 1000 ELSE 1 END, 0)::INT END AS amount,
        CASE WHEN m <> '' THEN CASE WHEN mu IN ('kg', 'g') THEN 'g' ELSE 'ml' END WHEN a IS NOT NULL THEN CASE WHEN u IN ('kg', 'g') THEN 'g' ELSE 'ml' END END AS unit, CASE WHEN m <> '' THEN m::INT WHEN a IS NOT NULL OR g <> '' THEN 1 END AS packs
        FROM (SELECT id, regexp_extract(t, '{MULTI}', 1) AS m, regexp_extract(t, '{MULTI}', 2) AS ma, regexp_extract(t, '{MULTI}', 3) AS mu, try_cast(replace(regexp_extract(t, '{SIZE}', 1), ',', '.') AS DOUBLE) AS a,
        regexp_extract(t, '{SIZE}', 2) AS u, regexp_extract(t, '[a-z](\\d{{3,4}})(?:[^\\d]|$)', 1) AS g FROM (SELECT id, {clean_sql('name')} AS t FROM products))""", "products"),
    "fn_name_tokens": with_tables(f"""SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace({clean_sql('name')}, '{MULTI}', ' '), '{SIZE}', ' '), '([a-z])(\\d{{3,}})', '\\1 \\2', 'g'), '(\\d{{3,}})([a-z])', '\\1 \\2', 'g'), '[a-z0-9]+'),
        lambda w: coalesce(map {{{", ".join(f"'{k}': '{v}'" for k, v in ABBREVIATIONS.items())}}}[w], w)), lambda w: length(w) >= 2 AND NOT regexp_full_match(w, '\\d+') AND w NOT IN ({", ".join(f"'{w}'" for w in FILLERS)})), '|') AS tokens FROM products""", "products"),
    "fn_when_label": """SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'em data não informada' WHEN l::DATE = DATE '2024-01-15' THEN 'hoje' || strftime(l, ' às %H:%M') WHEN l::DATE = DATE '2024-01-14' THEN 'ontem' || strftime(l, ' às %H:%M')
        ELSE strftime(l, 'em %d/%m às %H:%M') END AS label FROM (SELECT event_id, ts - INTERVAL 3 HOUR AS l FROM events)""",
    "flt_query_words": f"""SELECT conv_id, turn, CASE WHEN length(t) BETWEEN 2 AND 60 THEN array_to_string(regexp_extract_all(t, '[a-z0-9]+')[:6], ' ') ELSE '' END AS words FROM (SELECT *, {clean_sql("coalesce(text, '')")} AS t FROM conversations)""",
    "fn_size_label": with_tables(f"SELECT id, {_SL} AS label FROM ({_SIZED})", "products"),
    "fn_pack_label": with_tables(f"SELECT id, {_PL} AS label FROM ({_SIZED})", "products"),
    "fn_list_name": with_tables(f"""SELECT id, concat_ws(' · ', name, CASE WHEN coalesce(brand, '') <> '' AND NOT contains(lower(name), lower(brand)) THEN brand END,
        CASE WHEN NOT (s.unit = 'un' AND s.amount * s.pack = 1) AND NOT regexp_matches(name, '[0-9]') THEN {_PL} END) AS label FROM ({_SIZED})""", "products"),
    "fn_condition_label": with_tables("""SELECT id, coalesce(nullif(concat_ws(' · ', CASE WHEN offer = 'PinClube' THEN 'Só para membros do PinClube' END, CASE WHEN id % 3 = 0 THEN 'Exige cupom C10' END,
        CASE WHEN id % 4 > 1 THEN 'Levando ' || (id % 4) || ' un. ou mais' END, CASE WHEN id % 5 = 0 THEN 'Limite de ' || (id % 7 + 1) || ' por cliente' END,
        CASE WHEN id % 6 = 0 THEN 'Pagamento: Pix' END, CASE WHEN id % 8 = 0 THEN 'Só loja' END), ''), 'Sem condição especial') AS label FROM prices""", "prices"),
    "fn_stock_note": with_tables("SELECT id, 'Estoque informado pela loja: ' || replace(format('{:,}', stock * 100), ',', '.') || ' unidades' AS note FROM prices", "prices"),
    "fn_club": with_tables("SELECT id, nullif(regexp_extract(offer, '(?i)(\\w*clube\\w*)', 1), '') AS club FROM prices", "prices"),
    "fn_chain_key": with_tables("SELECT id, CASE WHEN id % 4 = 2 THEN 'pao d' || lower(name) ELSE lower(name) END AS key FROM stores", "stores"),
    "fn_address_clean": with_tables(f"""SELECT id, trim(regexp_replace(replace(regexp_replace(address || CASE id % 4 WHEN 0 THEN ', S/N' WHEN 1 THEN ' LOJA ' || (id % 30) WHEN 2 THEN ', Bloco B, sala 3' ELSE ', km 19' END || ', Brasil', '{COMPLEMENT}', ' ', 'g'), ' ,', ','), '\\s+', ' ', 'g')) AS address FROM branches""", "branches"),
    "fn_display_name": with_tables(f"""SELECT id, CASE WHEN id % 11 <> 0 THEN array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN regexp_matches(w, '(?i)^\\d+(?:[.,]\\d+)?(?:kg|g|mg|l|ml|un|und|cm|m)$') THEN lower(w) ELSE w END), ' ')
        ELSE array_to_string(list_transform(string_split(name, ' '), lambda w, i: CASE WHEN regexp_matches(w, '(?i)^\\d+(?:[.,]\\d+)?(?:kg|g|mg|l|ml|un|und|cm|m)$') THEN lower(w)
          WHEN i > 1 AND lower(w) IN ({", ".join(f"'{w}'" for w in SMALL)}) THEN lower(w)
          ELSE array_to_string(list_transform(string_split(lower(w), '-'), lambda x: upper(x[1]) || x[2:]), '-') END), ' ') END AS shown FROM products""", "products"),
}
