"""Each corpus operator against a brute-force version, and on nulls, empty texts, repeated rows and empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACE = r"[^\x20\x09-\x0D]+"


def corpus(seed=1, n=60):
    """Random texts with exact and near copies, shared passages, repeats, symbols and odd white space."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "the", "of"]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 90))]
        if i % 5 == 1 and texts:
            words = (texts[-1] or "x").split(" ")
        if i % 5 == 2 and len(texts) > 1:
            words = (texts[-2] or "x").split(" ")
            words[rng.randrange(len(words))] = "changed"
        if i % 7 == 3:
            words = words[:10] + passage + words[10:]
        if i % 11 == 4:
            words = ["again"] * 30 + words
        texts.append(" ".join(words).replace(" w7 ", "\n"))
    texts += [None, "", "  \t ", "one", "same line\nsame line\n### x", "a b  c\n\nd"]
    rows = [(i, t, "en" if i % 3 else "de", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[61 % len(rows)]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", "1 as shard", "'x' as TOXIC", "0.5 as score", "true as kept", "9 as node")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None), (None, "a b c " * 20, None, None, None), (5, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], r[0] % 2, r[0] % 3 == 0 and 1 or 0) for r in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality_counts(docs, rows, labels):
    from feira.llm.quality import quality

    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    for d, t, *_ in rows:
        t = t or ""
        words = re.findall(SPACE, t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(SPACE, line):
                dup += line in seen
                seen.add(line)
        runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        covered = {j for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert tuple(got[d])[1:6] == want
        assert got[d].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[d].base_failed and got[d].kept)


def test_trees_learn_and_keep_monotone():
    from feira.llm.quality import train

    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) & (x[:, 1] > 0.2)).astype(float)
    trees = train(x[:600], y[:600], np.array([-1, 0, 0]))
    assert ((trees.margins(x[600:]) > 0) == (y[600:] > 0.5)).mean() > 0.95  # held out
    line = np.column_stack([np.linspace(0, 1, 50), np.full(50, 0.7), np.full(50, 0.5)])
    assert (np.diff(trees.margins(line)) <= 1e-12).all()


def test_sharding_balances_and_numbers(docs, rows):
    from feira.llm.sharding import shard

    got = shard(docs, shards=4, tolerance=0.1).select("doc_id", "size", "shard", "slot").collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in v) - total / 4) <= 3 * largest for v in by.values())


def test_near_duplicates_equal_brute_force(docs, rows):
    from feira.llm.ngram_join import near_duplicates

    sets = {}
    for d, t, *_ in rows:
        w = re.findall(SPACE, "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    low = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()} == {(d, len(sets[d]), low[d]) for d in sets}


def test_blocked_product_finds_links_between_components(spark):
    from feira.llm.ngram_join import blocked_product

    sets = {i: np.unique(np.array([*range(100), 1000 + i, 2000 + i // 2], np.uint64)) for i in range(8)} | {9: np.arange(100, 300, dtype=np.uint64)}
    many = spark.createDataFrame([(7, i, i) for i in sets], "gram long, node long, component long")
    found = blocked_product(many, spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "node long, grams binary"), 75).collect()
    root = {i: i for i in sets}
    for r in found:
        a, b = root[r.a], root[r.b]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {v for k, v in root.items() if k != 9} == {0} and root[9] == 9


def test_licenses(spark):
    from feira.llm.license_scan import scan

    texts = {0: "x Under the MIT License. y under the mit-license", 1: "nothing here", 2: None, 3: "This work is licensed under the GNU General Public License, version 3.", 4: "mit license under the"}
    got = {r.doc_id: r for r in scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels, got[0].score) == (2, 1, 6, "mit", 1.0)
    assert (got[1].labels, got[2].n_words, got[3].labels, got[4].n_base) == ("", 0, "gpl", 0)


def test_surrogates(spark):
    from feira.llm.pii import replace_entities

    a, b = "ana.2@mail.example.com", "+1 (555) 123-4567"
    texts = [(0, f"mail {a} or {a.upper()} call {b}"), (1, f"again {a}; card 4111111111111111, ip 10.1.2.3"), (2, "clean text 12"), (3, None), (4, "Sra. Maria Souza and Mr. John Smith"), (4, "Sra. Maria Souza and Mr. John Smith")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = replace_entities(df, "k1").collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert a not in by[0].text and a.upper() not in by[0].text and b not in by[0].text
    mail = re.search(r"mail (\S+) or (\S+) call", by[0].text)
    assert mail[1].upper() == mail[2] and mail[1] in by[1].text and mail[1].endswith(".com")  # coreference
    assert re.search(r"\+\d \(\d{3}\) \d{3}-\d{4}", by[0].text)
    card = re.search(r"card (\d{16})", by[1].text)[1]
    assert sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 == 0 else int(c) for i, c in enumerate(card)) % 10 == 0
    assert by[2].text == "clean text 12" and by[3].text is None
    assert "Maria Souza" not in by[4].text and "Sra. " in by[4].text and re.search(r"Sra\. [A-Z][a-z]+ [A-Z][a-z]+ and Mr\. [A-Z][a-z]+ [A-Z][a-z]+", by[4].text)
    assert {r.text for r in replace_entities(df, "k2").collect()} != {r.text for r in got}


def test_substring_dedup_equals_brute_force(docs, rows):
    from feira.llm.substring_dedup import dedup

    words = {d: (t or "").encode().split() for d, t, *_ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - 12):
            first.setdefault(tuple(words[d][i : i + 13]), d)
    got = dedup(docs, chunk_bytes=900).collect()
    assert len(got) == len(rows)
    for r in got:
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < r.doc_id for j in range(i, i + 13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
        assert r.kept_text == (kept.decode() if len(w) >= 13 else None)


def test_hot_anchors_and_many_shards_change_nothing(docs, rows, monkeypatch):
    from feira.llm import substring_dedup

    want = sorted(map(tuple, substring_dedup.dedup(docs, with_text=False).collect()))
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    monkeypatch.setattr(substring_dedup, "SHARD_PIECES", 20)
    monkeypatch.setattr(substring_dedup, "BUCKET_ANCHORS", 50)
    assert sorted(map(tuple, substring_dedup.dedup(docs, with_text=False, chunk_bytes=600).collect())) == want


def test_plain_words_and_hashes(rows):
    import pyarrow as pa

    from feira.llm.common import plain_words, word_hashes

    texts = [r[1] for r in rows] + ["a" * 200 + " " + "a" * 201, "abcdefgh abcdefghi abcdefg abcdefghi", "\x0b\x0c\r\n", "é ü\u00a0x"]
    body, after, before = plain_words(pa.array(texts))
    words = [w for t in texts for w in (t or "").encode().split()]
    assert body.tobytes() == b"".join(w + b" " for w in words) and before[-1] == len(words) == len(after)
    assert np.diff(before).tolist() == [len((t or "").encode().split()) for t in texts]
    of = {}
    for w, h in zip(words, word_hashes(body, after).tolist(), strict=True):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


def test_fm_index_counts():
    from feira.llm.substring_dedup import FMIndex, suffix_order

    rng = np.random.default_rng(3)
    s = np.append(rng.integers(1, 4, 400), 0)
    s[[100, 101, 250]] = 0
    assert suffix_order(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    index = FMIndex(s)
    ends = np.flatnonzero(s)
    ends = ends[ends >= 5]
    length, low, high = index.matching_statistics(s, ends, 6)
    runs = lambda n: collections.Counter(tuple(s[i : i + n].tolist()) for i in range(len(s) - n + 1))
    counts = {n: runs(n) for n in range(1, 7)}
    for e, n, a, b in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist(), strict=True):
        most = max(m for m in range(1, 7) if m == 1 or (0 not in s[e - m + 1 : e + 1] and counts[m][tuple(s[e - m + 1 : e + 1].tolist())] > 1))
        run = tuple(s[e - n + 1 : e + 1].tolist())
        assert n == most and b - a == counts[n][run]
        assert sorted(index.places(np.arange(a, b)).tolist()) == [i for i in range(len(s)) if tuple(s[i : i + n].tolist()) == run]


def test_toxicity_on_held_out_rows(spark):
    from feira.llm.toxicity import fit, score

    rng = random.Random(5)
    bad, rows, labels = ["vile", "foul"], [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"v{rng.randrange(80)}" for _ in range(30)] + ([rng.choice(bad)] if toxic else [])
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    chain = fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.p_toxic >= chain.threshold for r in score(docs, chain).collect()}
    assert sum(got[i] == (i % 4 == 0) for i in range(400, 600)) >= 190 and not got[900] and not got[901]


def test_store_round_trip_and_random_access(spark, docs, rows, tmp_path):
    from tokenizers import Tokenizer

    from feira.llm.token_store import read_store, token_digest, token_range, tokenizer_path, write_store

    t = Tokenizer.from_file(tokenizer_path())
    odd = ["x<|endoftext|>y z", "<|endoftext|>", " a b ", "\n", "a\n\nb", "tab\there", "it's,, we'll!\nÄrger% 12,5 naïve...", "non\u00a0breaking", "a \n b", "word " * 30_000]
    rows = [*rows, *((1000 + i, x, "en", "src0", len(x)) for i, x in enumerate(odd))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want, all_ids, start = collections.Counter(), [], 0
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
        all_ids += ids
    assert collections.Counter(map(tuple, token_digest(docs).collect())) == want
    folder = write_store(docs, f"file://{tmp_path}/store", block_ids=200)
    assert [i for r in read_store(spark, folder).orderBy("start").collect() for i in r.ids] == all_ids
    part = token_range(spark, folder, 150, 400).orderBy("start").collect()
    assert [i for r in part for i in r.ids] == all_ids[150:550]


@pytest.mark.parametrize("width", [1, 7, 13, 16, 17, 31])
def test_packing(width):
    from feira.llm.token_store import block, open_block, unpack

    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype("<u4")
    payload, n = block([3, None], [ids[:300].tobytes(), ids[300:].tobytes()], width)
    names, offsets, packed, w = open_block(payload)
    assert (n, names, offsets.tolist(), w) == (1000, [3, None], [0, 300, 1000], width)
    assert (unpack(packed, w, 111, 500) == ids[111:611]).all()


def test_myers_equals_dynamic_programming():
    from feira.llm.decontaminate import myers

    rng = random.Random(2)
    for _ in range(200):
        p, t = ([bytes([rng.randrange(4)]) for _ in range(rng.randint(1, 80 if _ % 9 == 0 else 12))] for _ in range(2))
        row, best = list(range(len(p) + 1)), len(p)
        for w in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != w)))
            row, best = new, min(best, new[-1])
        assert myers(p, t)[0] == best


def test_decontamination(spark):
    from feira.llm.decontaminate import clean, matches

    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    texts = [(0, f"x y {item} z"), (1, item.replace("seven", "SEVN").upper()), (2, "nothing of this"), (3, None), (4, "one two three four five six"), (5, item.replace("three ", "").replace("twelve", "12"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, "short one"), (9, None), (None, item)], "item_id long, text string")
    got = {r.doc_id: r for r in matches(docs, items).collect()}
    assert {d: r.edits for d, r in got.items()} == {0: 0, 1: 1, 5: 2} and (got[0].first_word, got[0].last_word) == (2, 15)
    assert {r.doc_id for r in clean(docs, items).collect()} == {2, 3, 4}
    blocks = matches(docs, items.union(items.selectExpr("item_id + 1", "text")), block_words=10)
    assert blocks.count() == 6


def test_mixing_budgets(spark):
    from feira.llm.mixing import mix

    docs = spark.createDataFrame([(i, "w " * 10, "en" if i < 40 else "de", f"s{i % 2}", 20) for i in range(60)], SCHEMA)
    got = mix(docs, {"lang": {"de": 3, "en": 1}}, total_tokens=400, max_epochs=1).collect()
    n = collections.Counter(r.lang for r in got)
    assert n == {"de": 20, "en": 20}  # de wants 300 of its 200 tokens; its shortage goes to its sibling
    twice = mix(docs, {"lang": {"de": 1, "en": 0}}, total_tokens=300, max_epochs=2).collect()
    assert collections.Counter(r.mix_epoch for r in twice) == {0: 20, 1: 10}


def test_empty_tables_and_nulls(spark, none, nulls, labels):
    from feira.llm import decontaminate, license_scan, mixing, ngram_join, pii, quality, sharding, substring_dedup, token_store, toxicity

    no_labels = labels.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    runs = {
        "quality": lambda d: quality.quality(d, no_labels),
        "sharding": lambda d: sharding.shard(d, 4),
        "join": ngram_join.near_duplicates,
        "licence": license_scan.scan,
        "pii": lambda d: pii.replace_entities(d, "k"),
        "substring": substring_dedup.dedup,
        "toxicity": lambda d: toxicity.toxicity(d, no_labels),
        "tokens": token_store.token_digest,
        "mixing": lambda d: mixing.mix(d, total_tokens=1000),
    }
    for name, run in runs.items():
        assert run(none).count() == 0, name
        assert name == "mixing" or run(nulls).count() == 3, name
    assert decontaminate.matches(none, items).count() == 0 and decontaminate.clean(nulls, items).count() == 3


def test_components_over_long_chains(spark):
    from feira.llm.ngram_join import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_near_duplicates_of_drifting_copies_equal_brute_force(spark):
    from feira.llm.ngram_join import near_duplicates

    def family(seed):
        rng = random.Random(seed)
        vocabulary = [f"{seed}w{i}" for i in range(60)]
        out = [[rng.choice(vocabulary) for _ in range(24)]]
        for _ in range(rng.randint(2, 5)):
            w = list(rng.choice(out))
            for _ in range(rng.randint(1, 2)):
                op, k = rng.random(), rng.choice([0, 1, 2, len(w) - 1, len(w) - 2, rng.randrange(len(w))])
                w[k : k + 1] = [rng.choice(vocabulary)] if op < 0.5 else [rng.choice(vocabulary), w[k]] if op < 0.75 else []
            out.append(w)
        return out

    rows, want = [], {}
    for f in (572, 1051, 2042, 4269, 4819, 5786, 6068, 6391, 7720, *range(150)):  # the first nine hold pairs that are minor on either side
        texts = family(f)
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
        low = list(range(len(sets)))
        for _ in sets:
            for a in range(len(sets)):
                for b in range(len(sets)):
                    if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                        low[a] = low[b] = min(low[a], low[b])
        rows += [(f * 10 + i, " ".join(w)) for i, w in enumerate(texts)]
        want |= {f * 10 + i: f * 10 + x for i, x in enumerate(low)}
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_file_of_all_notices_has_all_labels(spark):
    from feira.llm.license_scan import TEMPLATES, scan

    notices = [notice for _, notice, _ in TEMPLATES]
    texts = [" filler ".join(notices), " filler ".join(n for label, n, _ in TEMPLATES if label in ("mit", "bsd", "all-rights-reserved")), *["all rights reserved"] * 20, *notices]
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == ",".join(sorted({label for label, *_ in TEMPLATES}))
    assert got[1] == "all-rights-reserved,bsd,mit"


def test_a_licence_with_changed_lines_is_known_by_its_clauses(spark):
    from feira.llm.license_scan import scan

    texts = [
        "Anyone may take this. The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Program.",
        "Do as you like.\n1. Redistributions of source code must retain the above (c) notice, this list of conditions.\n",
        "Unless required by applicable law or agreed to in writing, software is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "kind any of conditions or warranties without basis is as an on distributed unless required by applicable law or agreed to in writing",
        "the software portions substantial or copies all in included be shall notice permission",
    ]
    got = {r.doc_id: r.labels for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "mit", 1: "bsd", 2: "apache-2", 3: "", 4: ""}
