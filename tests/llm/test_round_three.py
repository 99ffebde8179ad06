"""Whitening, spelling variants and word-table encoding against plain versions, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

CLASHES = {"N": 7, "word": "x", "Packet": 1, "code": 2, "n_tokens": 3, "component": 4, "X": 5}


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHES.items()])


# ---- whitening


def plain_whitening(vectors, k=4):
    """Whole-number rows, fit list, eigenvectors by numpy."""
    x = np.floor(np.array(vectors, float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = int((values[:k] > 1e-12 * values.sum()).sum())
    y = (x - sums / n) @ axes[:, :kept] / np.sqrt(values[:kept])
    return n, ((n * x - sums) ** 2).sum(axis=1), y, values[:kept] / values.sum()


@pytest.mark.parametrize(("rows", "d", "rank"), [(300, 12, 12), (40, 5, 2), (9, 20, 20), (2, 3, 3), (60, 1, 1)])
def test_whitening_equals_eigenvectors(spark, rows, d, rank):
    from feira.llm.whitening import whiten

    rng = np.random.default_rng(rows + d)
    basis = np.round(rng.standard_normal((rank, d)) * 256) / 256 if rank < d else np.eye(d) * np.exp(-np.arange(d))[:, None]
    raw = [[float(c) for c in v] for v in (np.round(rng.standard_normal((rows, rank)) * 8) @ basis)]
    raw += raw[:3] * 5  # copies count once in the fit list
    df = clashing(spark.createDataFrame(list(enumerate(raw)), "vec_id long, embedding array<double>").repartition(3))
    got = collections.defaultdict(dict)
    for r in whiten(df).collect():
        got[r.vec_id][r.component] = r
    n, deviation, y, explained = plain_whitening(raw)
    assert sorted(got) == list(range(len(raw)))
    for c in range(y.shape[1]):
        mine = np.array([got[i][c + 1].whitened for i in range(len(raw))])
        sign = 1 if mine @ y[:, c] > 0 else -1
        assert np.abs(sign * mine - y[:, c]).max() < 1e-8
        assert abs(got[0][c + 1].explained / explained[c] - 1) < 1e-9
    assert all(len(v) == y.shape[1] for v in got.values())
    assert all((r.n, r.deviation) == (n, deviation[i]) and r.identity_error < 1e-9 for i, v in got.items() for r in v.values())


def test_whitening_finds_repeated_variances(spark):
    """A variance that several directions share needs more than one start."""
    from feira.llm.whitening import bidiagonalise

    x = np.repeat(np.diag([3.0, 3.0, 3.0, 2.0, 1.0, 1.0]), 2, axis=0) * np.tile([1, -1], 6)[:, None]
    sigma, right = bidiagonalise(lambda p: ((x @ p).T @ (x @ p[:, -1]), x.T @ (x @ p[:, -1])), 6, float((x**2).sum()), 4)
    assert np.allclose(sigma[:4] ** 2, [18, 18, 18, 8])
    assert np.allclose(right[:, :4].T @ right[:, :4], np.eye(4))
    assert np.allclose(x.T @ (x @ right[:, :4]), right[:, :4] * sigma[:4] ** 2)


def test_whitening_leaves_out_what_it_cannot_use(spark):
    from feira.llm.whitening import whiten

    good = [(1, [0.5, 0.25]), (2, [-1.0, 3.0]), (2, [-1.0, 3.0]), (None, [0.0, 1.0])]
    bad = [(5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (10, [1.0, 2.0, 3.0])]
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whiten(df(good + bad)).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 2, 2: 4, None: 2} and {r.n for r in got} == {3}
    assert whiten(df([])).count() == 0 and whiten(df(bad[:5])).count() == 0
    assert whiten(df([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # one distinct vector has no direction
    huge = whiten(df([(1, [3e38, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])])).collect()
    assert {r.vec_id: r.deviation for r in huge}[1] is None  # beyond a long


# ---- spelling variants


def plain_variants(rows):
    count = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) != 1:
            return False
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
        return a[k:] == b[k + 1 :]

    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    best = {w: min(v, key=lambda x: (-words[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in best.items() if words[f] >= 2 * words[w]}
    root = {}
    for w in words:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return {w: (form.get(w), root[w], n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


@pytest.mark.parametrize("symbols", [2, 8])
def test_variants_equal_all_pairs(spark, monkeypatch, symbols):
    from feira.llm import spelling

    monkeypatch.setattr(spelling, "SYMBOLS", symbols)
    monkeypatch.setattr(spelling, "MADE", 200)
    rng = random.Random(7)
    base = ["palavra", "aaaaa", "aaaaaa", "éàüñç", "abcdefgh", "x" * 63, "x" * 64, "x" * 65, "y" * 70, "y" * 71, "zz" + "y" * 70]
    pool = []
    for w in base:
        own = {w}
        for _ in range(12):
            v = rng.choice(sorted(own))
            i = rng.randrange(len(v) + 1)
            own.add(rng.choice([v[:i] + rng.choice("abéxy") + v[i:], v[:i] + v[i + 1 :], v[:i] + rng.choice("abéxy") + v[i + 1 :]]))
        pool += sorted(own)
    weights = [2 ** rng.randrange(7) for _ in pool]
    rows = [(i if i % 9 else None, " ".join(rng.choices(pool, weights, k=40)).replace("a", "A" if i % 2 else "a")) for i in range(120)]
    rows += [(1, None), (2, ""), (3, "123 - ÷×"), *rows[:5]]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(df).collect()}
    want = plain_variants(rows)
    assert got == want
    assert any(len(w) > spelling.LONG and v[3] for w, v in want.items()) and any(v[1] not in (w, v[0]) for w, v in want.items())


def test_neighbourhoods_are_whole_and_without_repeats():
    from feira.llm import spelling

    rng = np.random.default_rng(2)
    s = rng.integers(1, 4, (30, 6)).astype(np.uint64)
    alphabet = range(1, spelling.SYMBOLS + 1)
    found = collections.defaultdict(list)
    for rows, hashes in spelling.neighbourhoods(s):
        for r, h in zip(rows.tolist(), hashes.tolist(), strict=True):
            found[r].append(h)
    for r, own in enumerate(s.tolist()):
        want = {tuple(own)} | {tuple(own[:i] + own[i + 1 :]) for i in range(6)}
        want |= {tuple(own[:i] + [c] + own[i + k :]) for c in alphabet for i in range(7) for k in (0, 1) if i + k <= 6}
        hashes = {int(spelling.form_hashes(np.array([w], np.uint64))[0]) for w in want}
        assert len(found[r]) == len(hashes) and set(found[r]) == hashes


def test_variants_of_a_very_long_run_and_an_empty_table(spark):
    from feira.llm.spelling import group_variants

    long = "ab" * 20_000
    rows = [(i, f"{long} {long[:-1] if i % 2 else long + 'a'}") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n_near for r in group_variants(df).collect()}
    want = plain_variants(rows)
    assert got == {w: v[3] for w, v in want.items()} and max(got.values()) == 2
    assert group_variants(df.limit(0)).count() == 0


# ---- encoding and decoding by tables


def odd_texts(seed=3, n=600):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\u0085", " ", " ", "᠎", " ", " ", " ", "　", "​", "a", "b", "'s", "'ll", "n't", "'S", "1", "22", ",", "!?", "x,", "é!", "à", "é", "ł", "日本", "😀", "é", "<|endoftext|>", "<|endof", "\x00", "﻿"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(n)] + [(None, None), (5, ""), (5, ""), (7, "z" * 50_000), (8, "word, " * 30_000)]


def test_encoding_equals_the_tokenizer_and_decodes_back(spark):
    from tokenizers import Tokenizer

    from feira.llm.word_table import decode, encode, round_trip, tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    rows = odd_texts()
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids for _, t in rows}
    back = {t: plain.decode(v, skip_special_tokens=False) for t, v in ids.items()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = collections.Counter((d, len(ids[t]), sha(np.array(ids[t], "<u4").tobytes()), sha(back[t].encode())) for d, t in rows)
    assert collections.Counter(map(tuple, round_trip(df).collect())) == want
    encoded = encode(df)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == collections.Counter((d, tuple(ids[t])) for d, t in rows)
    assert collections.Counter(map(tuple, decode(encoded).collect())) == collections.Counter((d, back[t]) for d, t in rows)


def test_small_packets_and_parts_change_nothing(spark, monkeypatch):
    from feira.llm import word_table

    df = spark.createDataFrame(odd_texts(4, 200), "doc_id long, text string").repartition(2)
    before = collections.Counter(map(tuple, word_table.round_trip(df).collect()))
    monkeypatch.setattr(word_table, "PACKET_BYTES", 500)
    monkeypatch.setattr(word_table, "DEALT_WORDS", 50)
    assert collections.Counter(map(tuple, word_table.round_trip(df).collect())) == before


def test_decoding_ids_that_no_text_gave(spark):
    from tokenizers import Tokenizer

    from feira.llm.word_table import decode, tokenizer_path

    plain = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(1)
    lists = [[rng.randrange(50257) for _ in range(rng.randrange(30))] for _ in range(80)]  # broken UTF-8 among them
    got = dict(map(tuple, decode(spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")).collect()))
    assert got == {i: plain.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}
    odd = decode(spark.createDataFrame([(1, None), (2, []), (3, [None]), (4, [10**6, 5])], "doc_id long, ids array<int>"))
    assert dict(map(tuple, odd.collect())) == {1: "", 2: "", 3: "", 4: plain.decode([5])}


def test_a_tokenizer_that_changes_texts_is_given_them_whole(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from feira.llm.word_table import encode, in_words

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(1, "Hello  WORLD, it's"), (2, "É\tx"), (3, None)]
    got = {r.doc_id: list(r.ids) for r in encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert not in_words(path) and got == {d: plain.encode(t or "", add_special_tokens=False).ids for d, t in rows}


def test_empty_tables(spark):
    from feira.llm.word_table import decode, encode, round_trip

    none = spark.createDataFrame([], "doc_id long, text string")
    assert round_trip(none).count() == encode(none).count() == 0
    assert decode(spark.createDataFrame([], "doc_id long, ids array<int>")).count() == 0


# ---- names with forms of address of their own


def test_two_people_of_one_name_stay_two(spark):
    from feira.llm.pii import GIVEN, replace_entities

    texts = [
        "Mr. Lee and Mrs. Lee met Lee. Mr. Lee left.",
        "Mr. John Smith wrote. Mrs. Smith read; Mr. Smith and Smith slept.",
        "Mrs. Ana-Maria O'Neil saw Sr. García-López",
        "Dr. Ann Lee and Mr. Lee: Mr. Bo Lee, Mr. Al Lee",
        "call 555 123 4567, number 123 45 6789, not 1 555 123 4567 8",
    ]
    got = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    m = re.fullmatch(r"Mr\. (\w+) and Mrs\. (\w+) met (\w+)\. Mr\. (\w+) left\.", got[0])
    assert m and m[1] != m[2] and m[1] == m[4] and m[3] == m[2] and "Lee" not in got[0]
    assert {m[1].lower(), m[2].lower()}.isdisjoint(GIVEN["m-latin"] + GIVEN["f-latin"])  # lone words are family names
    m = re.fullmatch(r"Mr\. (\w+) (\w+) wrote\. Mrs\. (\w+) read; Mr\. (\w+) and (\w+) slept\.", got[1])
    assert m and m[1].lower() in GIVEN["m-latin"] and m[2] == m[4] == m[5] and m[3] != m[2]
    m = re.fullmatch(r"Mrs\. (\w+)-(\w+) ([A-Z])'([A-Z]\w+) saw Sr\. ([A-Z]\w+)-([A-Z]\w+)", got[2])
    assert m and {m[1].lower(), m[2].lower()} <= set(GIVEN["f-latin"])
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Mr\. (\w+): Mr\. (\w+) (\w+), Mr\. (\w+) (\w+)", got[3])
    assert m and m[4].lower() in GIVEN["m-latin"] and m[6].lower() in GIVEN["m-latin"] and (m[4], m[5]) != (m[6], m[7])
    assert re.fullmatch(r"call \d{3} \d{3} \d{4}, number \d{3} \d\d \d{4}, not 1 555 123 4567 8", got[4]) and "555 123 4567," not in got[4] and "123 45 6789" not in got[4]


@pytest.mark.parametrize("seed", [1, 2])
def test_titled_mentions_keep_their_person(spark, seed):
    """Random people of few names: a titled mention of a gender always gets that person's surrogate, the other gender another."""
    from feira.llm.pii import replace_entities

    rng = random.Random(seed)
    rows = [(i, " and ".join(f"{rng.choice(['Mr', 'Mrs'])}. {rng.choice(['Lee', 'Stone', 'Ford'])}" for _ in range(6))) for i in range(60)]
    got = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    to = {}
    for i, text in rows:
        old, new = (re.findall(r"(Mrs?)\. (\w+)", x) for x in (text, got[i]))
        assert [t for t, _ in old] == [t for t, _ in new]
        for a, b in zip(old, new, strict=True):
            assert to.setdefault(a, b[1]) == b[1]
    assert len(set(to.values())) == len(to) == 6


def test_a_packet_gets_a_row_for_each_distinct_id_not_for_each_id(spark):
    from pyspark.sql import functions as F

    from feira.llm.word_table import _entries, _with_own_pieces, encode_entries, round_trip, split_words, tokenizer_path

    texts = [" ".join(f"{a}{b}" for b in ("en", "ing", "ation", "e")) for a in ("th", "ou", "sh", "ch") for _ in range(50)]
    df = spark.createDataFrame([*enumerate(texts), (9000, None)], "doc_id long, text string").coalesce(1)
    known, _ = encode_entries(_entries(split_words(df, tokenizer_path())), tokenizer_path())
    rows = _with_own_pieces(known, tokenizer_path()).collect()
    ids = known.select("packet", F.explode("ids").alias("id")).collect()
    distinct = {(r.packet, r.id & 0xFFFF) for r in ids}
    assert len(distinct) < len(ids) and len(rows) == len(distinct) + len({r.packet for r in ids})
    assert {(r.packet, r.id) for r in rows if r.id is not None} == distinct and sum(r.words is not None for r in rows) == len({r.packet for r in ids})
    empty = hashlib.sha256(b"").hexdigest()
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, round_trip(nothing).collect()), key=repr) == [(1, 0, empty, empty), (2, 0, empty, empty), (None, 0, empty, empty)]


# ---- token ids: what an encoder remembers and gives to the tokenizer


def test_token_store_gives_the_tokenizer_short_texts_once(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute as pc
    from tokenizers import Tokenizer

    from feira.llm import token_store

    plain, encoder = Tokenizer.from_file(token_store.tokenizer_path()), token_store.Encoder(token_store.tokenizer_path())
    given = []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return plain.encode_batch_fast(texts, **options)

    encoder.tokenizer = Watched()
    rng = random.Random(8)
    texts = ["", "\n", " a", "b ", *("".join(rng.choice(["qu", "é", "x1", "日", " w", "\nu", ",.", "'s", "!"]) for _ in range(rng.randrange(40))) for _ in range(3000))]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder(pa.array(texts)) == want
    assert max(t.count("\n") for t in given) < 64  # long texts of many pieces cost more than twice as much
    given.clear()
    assert encoder(pa.array(texts)) == want
    odd = pc.match_substring_regex(pa.array(given, pa.string()), encoder.whole_if).to_pylist()
    assert all(odd)  # all others are remembered
    monkeypatch.setattr(token_store, "CACHE", 50)
    assert all(encoder(pa.array(texts[k : k + 200])) == want[k : k + 200] for k in range(0, len(texts), 200))  # begun anew each time
