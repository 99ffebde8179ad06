"""Operator 5: surrogates for personal data, in DataFrame and SQL functions only.

Detected entities (e-mail addresses, phone, card, account (IBAN) and social security numbers, IP addresses, secret hex
keys, and names) are replaced by values of the same kind, made from a keyed hash of the entity. Digits stay digits,
letters stay letters of their script and case, separators stay, card and account numbers keep right check digits, names
keep the gender of their form of address and the script they are written in.

Names: one after a form of address (Mr, Frau, Sra, Dr, ...; up to three words, with particles such as "da" or "von" and
parts joined by hyphen or apostrophe) makes the name known to its document. There its bare mentions are replaced too: the
whole name, its first and its last word. A name of one word that ends or begins a longer known one is the same person,
unless their forms of address tell different genders. A mention with a form of address of its own is the person it tells:
"Mr. Lee" and "Mrs. Lee" are two, each with a surrogate. A bare mention that several people share is the one with the longer
name, then the one whose gender is told, then a woman, then the first in order of letters. A word that stands alone
after a form of address is taken for a family name; hyphens and apostrophes stay where they are in a name.

Coreference: an entity is its canonical form (no separators, no case), and all its mentions get one surrogate, each in
the mention's own format; a part of a name gets that part of the surrogate. Distinctness: over all documents, no two
entities of a kind share a surrogate as it is seen and none equals an entity of the corpus; those that would collide draw
again with the next attempt.

Edge cases: null and empty texts and texts without entities pass unchanged; repeated rows get equal results (also when
doc_id is null); an empty table gives no rows; columns named like the added ones are replaced, all others stay. Patterns
hold no repeated group without a small bound, so a line of any length is matched without deep recursion. Names without a
form of address anywhere in their document aren't found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feira.llm.common import fresh, no_rows, table, written

#: Forms of address by the gender they tell ("n": either).
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Senhor", "Sr", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Senhora", "Sra", "Dra", "Госпожа", "Κυρία"),
    "n": ("Dr", "Prof"),
}
#: Words inside names that are written small.
PARTICLES = ("da", "de", "do", "das", "dos", "del", "der", "den", "di", "du", "la", "le", "van", "von")

#: Given names by gender and script; family names are built from SYLLABLES of the script.
GIVEN = {
    "m-latin": ("alan", "bruno", "carlos", "david", "emil", "felix", "hugo", "ivan", "jonas", "lucas", "martin", "oscar", "paul", "ralf", "simon", "victor"),
    "f-latin": ("alice", "berta", "clara", "diana", "elena", "frida", "greta", "helen", "irene", "julia", "laura", "maria", "nina", "paula", "sofia", "vera"),
    "m-cyrillic": ("алексей", "борис", "виктор", "глеб", "денис", "егор", "иван", "максим", "никита", "олег", "павел", "роман", "семен", "тимур", "федор", "юрий"),
    "f-cyrillic": ("алина", "вера", "галина", "дарья", "елена", "жанна", "ирина", "ксения", "лариса", "мария", "нина", "ольга", "полина", "раиса", "софия", "юлия"),
    "m-greek": ("ανδρεας", "γιωργος", "δημητρης", "ηλιας", "θανασης", "κωστας", "λεωνιδας", "μανος", "νικος", "πετρος", "σταθης", "σπυρος", "τασος", "φανης", "χρηστος", "ορεστης"),
    "f-greek": ("αννα", "βασω", "γεωργια", "δεσποινα", "ελενη", "ζωη", "ηρω", "ιωαννα", "κατια", "λενα", "μαρια", "νικη", "ολγα", "ρενα", "σοφια", "χρυσα"),
}
GIVEN |= {f"n-{script}": GIVEN[f"m-{script}"] + GIVEN[f"f-{script}"] for script in ("latin", "cyrillic", "greek")}
SYLLABLES = {
    "latin": ("ba", "ce", "do", "fa", "ge", "ka", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zu"),
    "cyrillic": ("ба", "во", "га", "де", "жи", "зо", "ки", "ла", "ме", "но", "пу", "ра", "си", "та", "фе", "ши"),
    "greek": ("βα", "γο", "δε", "ζη", "θα", "κι", "λα", "με", "νο", "πι", "ρα", "σο", "τα", "φε", "χι", "ψα"),
}
ALPHABETS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "а-я": "абвгдежзиклмнопрстуфхцчшэюя", "α-ω": "αβγδεζηθικλμνξοπρστυφχψω"}

_LOCAL = r"\p{L}\p{N}._%+-"
_APART = r"[^\p{L}\p{N}\n(]"  # what may part the groups of a number
_TITLE = "(?:" + "|".join(f"{t}|{t.upper()}" for ts in TITLES.values() for t in ts) + ")"
_REST = r"(?:['’-]\p{L}++){0,3}"
_WORD = rf"(?!{_TITLE}(?!\p{{L}}))\p{{Lu}}(?:\p{{L}}++{_REST}|['’]\p{{L}}++{_REST})"
#: Group 1: the form of address; group 2: the name.
TITLED = rf"(?<!\p{{L}})({_TITLE})\.? {{1,3}}({_WORD}(?:(?: {{1,3}}(?:{'|'.join(PARTICLES)})(?!\p{{L}})){{0,2}} {{1,3}}{_WORD}){{0,2}})"

#: Kind and pattern, in order of preference at one place.
PATTERNS = (
    ("email", rf"(?<![{_LOCAL}])[{_LOCAL}]++@[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}.-]*\.\p{{L}}{{2,63}}"),
    ("secret", r"(?=[a-fA-F]*[0-9])(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![\p{L}\p{N}])"),
    ("phone", rf"(?<![0-9+])(?:\+[0-9]{{1,3}}{_APART}{{1,4}})?\([0-9]{{2,4}}\){_APART}{{0,4}}[0-9]{{3,4}}[ .-][0-9]{{3,4}}(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"),
    ("phone", r"(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![0-9.-]|[0-9] )[0-9]{3} [0-9]{3} [0-9]{4}(?![0-9-]| [0-9])"),
    ("card", r"(?<![0-9.])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("ssn", r"(?<![0-9.-]|[0-9] )[0-9]{3} [0-9]{2} [0-9]{4}(?![0-9-]| [0-9])"),
    ("ip", r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[0-9])"),
    ("ipv6", r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]{0,40}[0-9])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])"),
)
PLAIN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Kinds whose mentions keep their separators, and what their canonical form drops.
PARTED = {"phone": "[^0-9]", "card": "[^0-9]", "ssn": "[^0-9]", "iban": "[^0-9a-z]"}
MAX_ATTEMPTS = 64
#: Parts of a word of a name, with the marks between them.
_PARTS = "(?<=['’-])|(?=['’-])"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(PATTERNS):  # look-behinds hold at the start of the entity alone
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _script(text: str) -> str:
    return f"case when {text} rlike '\\\\p{{IsCyrillic}}' then 'cyrillic' when {text} rlike '\\\\p{{IsGreek}}' then 'greek' else 'latin' end"


def _canonical(kind: Column, entity: Column) -> Column:
    """The form all mentions of an entity that isn't a name share."""
    low = F.lower(entity)
    out = low
    for name, drop in PARTED.items():
        out = F.when(kind == name, F.regexp_replace(low, drop, "")).otherwise(out)
    return out


def _gender(title: str) -> str:
    """SQL: the gender that a form of address tells; null for none."""
    return "case " + " ".join(f"when lower({title}) in ({', '.join(_sql(x.lower()) for x in ts)}) then {_sql(g)}" for g, ts in TITLES.items()) + " end"


def with_names(docs: DataFrame) -> DataFrame:
    """``docs`` with pii_names, the names that a document makes known: an array of struct(form, canonical, part), a row for
    each form a mention may take (part: all, first or last word); and pii_pattern, which finds every entity of the text."""
    gender = _gender("t")
    found = F.expr(
        f"""array_distinct(transform(arrays_zip(regexp_extract_all(text, {_sql(TITLED)}, 1), regexp_extract_all(text, {_sql(TITLED)}, 2)),
        z -> transform(array(struct(z.`0` as t, lower(regexp_replace(z.`1`, ' +', ' ')) as name)), x -> struct(x.name as name, concat({gender.replace("lower(t)", "lower(x.t)")}, '-', {_script("x.name")}) as who))[0]))"""
    )
    some = F.coalesce(F.col("text"), F.lit("")).rlike(rf"(?<!\p{{L}}){_TITLE}\.? ")
    docs = docs.withColumn("pii_names", F.when(some, found).otherwise(F.array().cast("array<struct<name:string,who:string>>")))
    # one person: the name with most words, then in order; a gender that a title tells before one that none does
    forms = """array_sort(flatten(transform(pii_names, x -> transform(array(concat(x.who, ':', x.name)), c -> case when x.name like '% %' then array(
        struct(x.name as form, case when x.who like 'n%' then 1 else 0 end as rank, c as canonical, 'all' as part),
        struct(substring_index(x.name, ' ', -1) as form, case when x.who like 'n%' then 3 else 2 end as rank, c as canonical, 'last' as part),
        struct(substring_index(x.name, ' ', 1) as form, case when x.who like 'n%' then 5 else 4 end as rank, c as canonical, 'first' as part))
        else array(struct(x.name as form, case when x.who like 'n%' then 7 else 6 end as rank, c as canonical, 'all' as part)) end)[0])))"""
    docs = docs.withColumn("pii_names", F.expr(forms))
    ordered = "array_sort(array_distinct(transform(pii_names, x -> x.form)), (a, b) -> case when length(a) <> length(b) then length(b) - length(a) when a < b then -1 when a > b then 1 else 0 end)"
    known = F.expr(f"replace(array_join({ordered}, '|'), ' ', ' {{1,3}}')")
    named = F.concat(F.lit(PLAIN + r"|(?:(?<![\p{L}\p{N}])(?=\p{Lu})(?iu:"), known, F.lit(r")(?![\p{L}\p{N}]))"))
    return docs.withColumn("pii_pattern", F.when(F.size("pii_names") > 0, named).otherwise(F.lit(PLAIN)))


def _byte(place: str) -> str:
    """SQL: the ``place``-th byte of the entity's keyed digest, going round."""
    return f"cast(conv(substring(digest, 2 * (({place}) % 64) + 1, 2), 16, 10) as int)"


def _candidate() -> Column:
    """A surrogate in canonical form from (kind, canonical, digest, attempt)."""
    alphabet = "".join(f"when c rlike '[{span}]' then substring('{letters}', {_byte('i')} % {len(letters)} + 1, 1) " for span, letters in ALPHABETS.items())
    shaped = f"array_join(transform(split({{0}}, ''), (c, i) -> case when c rlike '[0-9]' then cast({_byte('i')} % 10 as string) {alphabet} else c end), '')"
    longer = f"array_join(transform(sequence(0, attempt), i -> substring('abcdefghijklmnopqrstuvwxyz', {_byte('40 + i')} % 26 + 1, 1)), '')"
    tld = "regexp_extract(canonical, '[.][^.]+$', 0)"
    body = shaped.format(f"substring(canonical, 1, length(canonical) - length({tld}))")
    email = f"concat(case when attempt > 3 then {longer} else '' end, {body}, {tld})"
    luhn = "pmod(10 - pmod(aggregate(transform(split({0}, ''), (c, i) -> case when i % 2 = 0 then cast(c as int) * 2 - case when cast(c as int) > 4 then 9 else 0 end else cast(c as int) end), 0, (a, x) -> a + x), 10), 10)"
    first15 = f"array_join(transform(sequence(0, 14), i -> cast({_byte('i')} % 10 as string)), '')"
    right = f"{luhn.format('substring(canonical, 1, 15)')} = cast(substring(canonical, 16, 1) as int)"
    card = f"case when {right} then concat({first15}, cast({luhn.format(first15)} as string)) else {shaped.format('canonical')} end"
    ip = f"array_join(transform(sequence(0, 3), i -> cast({_byte('i')} % 254 + 1 as string)), '.')"
    secret = f"array_join(transform(split(canonical, ''), (c, i) -> substring(digest, ({_byte('63')} + i) % 128 + 1, 1)), '')"
    given = "case " + " ".join(f"when canonical like '{k}:%' then element_at(array({', '.join(map(_sql, v))}), {_byte('0')} % {len(v)} + 1)" for k, v in GIVEN.items()) + " end"
    syllable = "case " + " ".join(f"when canonical rlike '^.-{k}:' then element_at(array({', '.join(map(_sql, v))}), {_byte('1 + i')} % {len(v)} + 1)" for k, v in SYLLABLES.items()) + " end"
    family = f"array_join(transform(sequence(0, 2 + attempt), i -> {syllable.replace('1 + i', '1 + i + 5 * j + 11 * k')}), '')"
    small = f"w in ({', '.join(map(_sql, PARTICLES))})"
    part = f"case when p rlike \"^['’-]$\" then p when j = 0 and canonical like '% %' then {given.replace(_byte('0'), _byte('3 * k'))} else transform(array({family}), f -> case when length(p) = 1 then substring(f, 1, 1) else f end)[0] end"
    name = f"array_join(transform(split(regexp_replace(canonical, '^[^:]+:', ''), ' '), (w, j) -> case when {small} then w else array_join(transform(split(w, {_sql(_PARTS)}), (p, k) -> {part}), '') end), ' ')"
    hexes = f"array_join(transform(split(canonical, ''), (c, i) -> case when c = ':' then c else substring(digest, ({_byte('63')} + i) % 128 + 1, 1) end), '')"
    number = "aggregate(split(upper(concat({0}, substring(canonical, 1, 2), '00')), ''), 0, (a, c) -> case when c rlike '[0-9]' then (a * 10 + cast(c as int)) % 97 else (a * 100 + ascii(c) - 55) % 97 end)"
    account = f"transform(array({shaped.format('substring(canonical, 5)')}), b -> concat(substring(canonical, 1, 2), lpad(cast(98 - {number.format('b')} as string), 2, '0'), b))[0]"
    return F.expr(f"case kind when 'email' then {email} when 'card' then {card} when 'ip' then {ip} when 'secret' then {secret} when 'ipv6' then {hexes} when 'iban' then {account} when 'name' then {name} else {shaped.format('canonical')} end")


def _mention() -> Column:
    """The surrogate in the format of one mention (kind, entity, part, surrogate)."""
    place = "length(regexp_replace(substring(entity, 1, i + 1), '{0}', ''))"
    digits = f"array_join(transform(split(entity, ''), (c, i) -> case when c rlike '[0-9]' then substring(surrogate, {place.format('[^0-9]')}, 1) else c end), '')"
    account = f"array_join(transform(split(entity, ''), (c, i) -> case when c rlike '[0-9A-Z]' then upper(substring(surrogate, {place.format('[^0-9A-Z]')}, 1)) else c end), '')"
    plain = "case part when 'first' then substring_index(surrogate, ' ', 1) when 'last' then substring_index(surrogate, ' ', -1) else surrogate end"
    shout = "entity rlike '\\\\p{Lu}' and not entity rlike '\\\\p{Ll}'"
    small = f"w in ({', '.join(map(_sql, PARTICLES))})"
    titled = f"array_join(transform(split({plain}, ' '), w -> case when {small} then w else array_join(transform(split(w, {_sql(_PARTS)}), p -> initcap(p)), '') end), ' ')"
    name = f"case when length(entity) > 1 and {shout} then upper({plain}) else {titled} end"
    cased = f"case when {shout} then upper(surrogate) when length(surrogate) = length(entity) then array_join(transform(split(surrogate, ''), (c, i) -> case when substring(entity, i + 1, 1) rlike '\\\\p{{Lu}}' then upper(c) else c end), '') else surrogate end"
    return F.expr(f"case when kind in ('phone', 'card', 'ssn') then {digits} when kind = 'iban' then {account} when kind = 'name' then {name} else {cased} end")


def _hint(text: Column) -> Column:
    """What every text with an entity has: a digit, an at sign or a form of address. No pattern is tried elsewhere."""
    out = text.rlike("[0-9@]")
    for t in (x for ts in TITLES.values() for x in ts):
        out = out | text.contains(t) | text.contains(t.upper())
    return out


def _near(line: Column) -> Column:
    """Whether a line of a document may hold an entity: by itself, or as the document has a known name."""
    return _hint(line) | (F.size("pii_names") > 0)


def _lines() -> Column:
    """Lines of ``text``; no entity goes over the end of one."""
    return F.split("text", "\n", -1)


def find_entities(docs: DataFrame) -> DataFrame:
    """A row for each mention: doc_id, text_hash, line_no, place in the line (from 0), kind, entity, canonical, part."""
    lines = with_names(docs.filter(_hint(F.col("text"))).select("doc_id", "text"))
    lines = lines.select("doc_id", F.xxhash64("text").alias("text_hash"), "pii_names", "pii_pattern", F.posexplode(_lines()).alias("line_no", "line")).filter(_near(F.col("line")))
    found = F.expr("regexp_extract_all(line, pii_pattern, 0)")
    # the end of what stands before each mention, where a form of address may be
    before = F.when(F.size("pii_names") > 0, F.transform(F.split("line", F.col("pii_pattern"), -1), lambda x: F.right(x, F.lit(24)))).otherwise(F.array().cast("array<string>"))
    each = lines.select("doc_id", "text_hash", "line_no", "pii_names", F.posexplode(F.arrays_zip(found.alias("entity"), before.alias("before"))).alias("place", "x"))
    each = each.select("doc_id", "text_hash", "line_no", "pii_names", "place", "x.entity", "x.before").filter("entity is not null")
    title = F.regexp_extract("before", rf"(?<!\p{{L}})({_TITLE})\.? {{1,3}}$", 1)
    each = each.withColumn("kind", _kind(F.col("entity"))).withColumn("title", title).withColumn("told", F.expr(_gender("title"))).drop("before")
    form = F.lower(F.regexp_replace("entity", " +", " "))
    other = F.when(F.col("told") == "m", "f-%").when(F.col("told") == "f", "m-%").otherwise("")
    # the forms are in order, the best reading first; a form of address rules out the other gender
    person = F.filter("pii_names", lambda x: (x["form"] == form) & ~F.like(x["canonical"], other))[0]
    is_name = F.col("kind") == "name"
    return each.select(
        "doc_id", "text_hash", "line_no", "place", "kind", "entity", F.when(is_name, person["canonical"]).otherwise(_canonical(F.col("kind"), F.col("entity"))).alias("canonical"), F.when(is_name, person["part"]).otherwise("all").alias("part")
    )


def _seen(canonical: Column) -> Column:
    """A name as it is seen, without what it says about the person."""
    return F.regexp_replace(canonical, "^[mfn]-[a-z]+:", "")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, canonical; distinct) with ``surrogate``, distinct within a kind and never an entity itself."""
    taken = entities.select("kind", _seen(F.col("canonical")).alias("surrogate"))
    rounds: list[DataFrame] = []
    open_ = entities
    for attempt in range(MAX_ATTEMPTS):
        digest = F.sha2(F.concat_ws(":", F.lit(key), F.lit(str(attempt)), "kind", "canonical"), 512)
        drawn = written(open_.withColumns({"attempt": F.lit(attempt), "digest": digest}).withColumn("surrogate", _candidate()).drop("digest", "attempt"), "pii-drawn")
        free = drawn.join(taken, ["kind", "surrogate"], "left_anti")
        won = written(free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"), "pii-surrogates")
        rounds.append(won)  # each round writes its winners only
        taken = taken.unionAll(won.select("kind", "surrogate"))
        open_ = drawn.select("kind", "canonical").join(won, ["kind", "canonical"], "left_anti")
        if no_rows(open_):
            return reduce(DataFrame.unionAll, rounds)
        open_ = written(open_, "pii-open")
    raise RuntimeError(f"entities without a free surrogate after {MAX_ATTEMPTS} attempts")


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities.

    key: secret of the keyed hash; with another key every surrogate differs. Texts without an entity never move.
    """
    docs = fresh(docs, "n_entities", "pii_names", "pii_pattern", "pii_hash", "pii_swaps")
    mentions = written(find_entities(docs), "pii-mentions")
    entities = written(mentions.select("kind", "canonical").distinct(), "pii-entities")
    surrogates = assign_surrogates(entities, key)
    swaps = mentions.distinct().join(surrogates, ["kind", "canonical"]).withColumn("swap", _mention())
    by_text = swaps.groupBy(F.col("doc_id").alias("swap_id"), F.col("text_hash").alias("swap_hash")).agg(
        F.count("*").cast("int").alias("n_entities"), F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "line_no", "place"), "swap"))).alias("pii_swaps")
    )
    by_text = by_text.select(*[F.col(c).alias(f"pii_{c}") for c in ("swap_id", "swap_hash", "n_entities")], "pii_swaps")
    titled = F.coalesce(F.col("text"), F.lit("")).rlike(TITLED)
    has = F.coalesce(_hint(F.col("text")) & (titled | F.exists(_lines(), lambda x: _hint(x) & (F.regexp_count(x, F.lit(PLAIN)) > 0))), F.lit(False))
    none = docs.filter(~has).withColumn("n_entities", F.lit(0))
    some = with_names(docs.filter(has)).withColumn("pii_hash", F.xxhash64("text"))
    some = some.join(by_text, F.expr("doc_id <=> pii_swap_id and pii_hash = pii_swap_hash"), "left")

    def swapped(line: Column, number: Column) -> Column:
        piece = lambda p, i: F.concat(p, F.coalesce(F.element_at("pii_swaps", F.concat_ws(":", number, i)), F.lit("")))
        return F.when(_near(line), F.array_join(F.transform(F.split(line, F.col("pii_pattern"), -1), piece), "")).otherwise(line)

    text = F.when(F.col("pii_swaps").isNull(), F.col("text")).otherwise(F.array_join(F.transform(_lines(), swapped), "\n"))
    some = some.select(*[(text.alias(c) if c.lower() == "text" else F.col(f"`{c}`")) for c in docs.columns], F.coalesce("pii_n_entities", F.lit(0)).alias("n_entities"))
    return none.unionByName(some)


def op5_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, key="feira-surrogates")


QUERIES = {"op5_pii": op5_pii}
