"""Operators that SQL can't express against plain versions, and every operator and stage on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text):
    return re.findall(WORD, text or "")


def folded_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


# ---- sharding


@pytest.mark.parametrize("seed", [1, 2])
def test_shards_are_cut_at_the_nearest_keys(spark, seed):
    from feira.llm.sharding import shard

    rng = random.Random(seed)
    rows = [(i, "same" if i % 3 == 0 else "x" * rng.randrange(200) + str(i % 90)) for i in range(600)] + [(7, "same")] * 40
    got = shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, tolerance=0.05).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows) and all(r.size == len(r.text.encode()) + 16 for r in got)
    total = sum(r.size for r in got)
    keys = collections.Counter()
    for r in got:
        keys[r.text, r.doc_id] += r.size
    for k in range(5):
        mine = [r for r in got if r.shard == k]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        # each end is within the tolerance of a range (an eighth of a shard), or no key lies nearer
        assert abs(sum(r.size for r in mine) - total / 5) <= 2 * max(0.05 * total / 40, max(keys.values()))
    homes = collections.defaultdict(set)
    for r in got:
        homes[r.text, r.doc_id].add(r.shard)
    assert all(len(v) == 1 for v in homes.values())  # equal keys stay together


# ---- licences


def plain_cover(notice, near, idf):
    """Weight of the heaviest common subsequence, by the textbook recursion."""
    from functools import cache

    @cache
    def heaviest(i, j):
        if i == len(notice) or j == len(near):
            return 0.0
        skip = max(heaviest(i + 1, j), heaviest(i, j + 1))
        return max(skip, idf[near[j].encode()] + heaviest(i + 1, j + 1)) if notice[i] == near[j] else skip

    return heaviest(0, 0)


def test_licence_labels_equal_a_plain_scan(spark):
    from feira.llm.license_scan import ANCHORS, BASE_PHRASES, LEAST_COVER, SLACK, TEMPLATES, VOTES, scan, word_idf

    rng = random.Random(4)
    filler = ["the", "of", "code", "fee", "public", "copy", "kind", "software", "license", "b1", "b2"]
    texts = [None, "", "permission"]
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = rng.choice(filler)
            parts.append(" ".join(w[: rng.choice([len(w), len(w), len(w) // 2])]))
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randrange(30))))
        texts.append((", ".join(parts)).upper() if i % 4 == 0 else "\n".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    idf = word_idf(df)
    n = len(texts)
    for w, v in idf.items():
        import math

        assert abs(v - (math.log((n + 1) / (sum(w.decode() in folded_words(t) for t in texts) + 1)) + 1)) < 1e-9
    for r in scan(df).collect():
        w = folded_words(texts[r.doc_id])
        base = [(i, label) for p, label in BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        labels = {label for _, label in base}
        for label, notice, keys in TEMPLATES:
            t = notice.split()
            rarest = lambda of, n: sorted(set(of), key=lambda x: (-idf[x.encode()], x.encode()))[:n]
            rare = set(rarest(t, ANCHORS)).union(*(rarest(k.split(), VOTES) for k in keys))
            votes = sorted({(j - q, x) for j, x in enumerate(w) if x in rare for q, y in enumerate(t) if y == x})
            for s, _ in votes:
                if len({x for p, x in votes if s <= p <= s + SLACK}) < min(VOTES, len(rare)):
                    continue
                near = w[max(0, s - SLACK) : s + len(t) + 2 * SLACK]
                cover = plain_cover(t, near, idf) / sum(idf[x.encode()] for x in t)
                if cover >= LEAST_COVER and any(f" {k} " in f" {' '.join(near)} " for k in keys):
                    labels.add(label)
        assert (r.n_words, r.n_base) == (len(w), len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in base})) and r.labels == ",".join(sorted(labels)), r.doc_id


# ---- personal data


def test_surrogates_are_distinct_consistent_and_typed(spark):
    from feira.llm.pii import replace_entities

    rng = random.Random(6)
    mail = lambda: f"{rng.choice('abcdef')}{rng.randrange(30)}@{rng.choice(['ab', 'cd'])}.org"
    phone = lambda: f"({rng.randrange(200, 230)}) {rng.randrange(200, 240)}-{rng.randrange(1000, 1020)}"
    ip = lambda: f"10.{rng.randrange(3)}.{rng.randrange(9)}.{rng.randrange(9)}"
    makers = {"mail": (mail, r"[a-z]+[0-9]+@[a-z]+\.org"), "phone": (phone, r"\(\d{3}\) \d{3}-\d{4}"), "ip": (ip, r"\b\d+\.\d+\.\d+\.\d+\b")}
    rows = []
    for i in range(150):
        parts = [f"word {make()}" for make, _ in makers.values() for _ in range(rng.randrange(3))]
        rows.append((i, "\n".join(parts) if i % 2 else " and ".join(parts)))
    got = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for _, pattern in makers.values():
        to, entities = {}, set()
        for d, text in rows:
            old, new = re.findall(pattern, text), re.findall(pattern, got[d])
            assert len(old) == len(new)
            entities |= set(old)
            for a, b in zip(old, new, strict=True):
                assert to.setdefault(a, b) == b  # one surrogate for an entity, over all documents
        assert len(set(to.values())) == len(to) and not set(to.values()) & entities
    strip = lambda t: re.sub("|".join(p for _, p in makers.values()), "#", t)
    assert all(strip(t) == strip(got[d]) for d, t in rows)  # nothing else changes


def test_names_are_linked_within_a_document(spark):
    from feira.llm.pii import replace_entities

    texts = [
        "Mr. John Smith met us. John Smith said hello to Mr. Smith.\nSMITH left, and smith-work stayed.",
        "Sr. José da Silva und MR. O'Neil-Brown, Dr.  Ann Lee; Ann and Lee. José, Silva",
        "John Smith without a title",
        "Frau Müller sah Herrn. Müller",
        "call 555-123-4567 or pay DE89 3704 0044 0532 0130 00 from 2001:db8::1 at 12:30:45, ratio 3::2a",
    ]
    got = {r.doc_id: r.text for r in replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met us\. (\w+) (\w+) said hello to Mr\. (\w+)\.\n(\w+) left, and smith-work stayed\.", got[0])
    assert m and m[1] == m[3] and m[2] == m[4] == m[5] and m[6] == m[2].upper() and {m[1], m[2]}.isdisjoint({"John", "Smith"})
    m = re.fullmatch(r"Sr\. (\w+) da (\w+) und MR\. (\S+), Dr\.  (\w+) (\w+); (\w+) and (\w+)\. (\w+), (\w+)", got[1])
    assert m and (m[4], m[5]) == (m[6], m[7]) and (m[1], m[2]) == (m[8], m[9]) and "O'Neil" not in m[3]
    assert got[2] == texts[2] and "Müller" not in got[3]
    assert "555-123-4567" not in got[4] and "2001:db8" not in got[4] and "12:30:45" in got[4]
    account = re.search(r"pay (DE\d\d(?: \d{4}){4} \d\d) from", got[4])[1].replace(" ", "")
    assert account != "DE89370400440532013000" and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_long_lines_do_not_break_the_patterns(spark):
    from feira.llm.pii import replace_entities

    texts = ["x@a" + ".a" * 2000 + " end", "." * 20_000, "Mr. Bob Stone " + "y" * 5_000_000, "@" * 20_000, "1.2" * 20_000, "Aa-" * 20_000, ("Mr. " + "Ab-" * 200) * 20]
    got = replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    assert len(got) == len(texts) and "Bob Stone" not in next(r.text for r in got if r.doc_id == 2)


# ---- toxicity


def test_scores_equal_a_plain_chain(spark):
    import numpy as np

    from feira.llm.toxicity import Chain, score, train_chain

    chain = Chain({b"bad": 0, b"worse": 1}, np.array([[1.0, 0.5, 2.0], [2.0, 0.0, 1.0]]), np.array([-1.0, -2.0, -1.5]), np.array([[0, 0, 0], [1.5, 0, 0], [0.5, 2.0, 0]], float))
    texts = [None, "", "BAD day", "worse, bad!", "good", "bad " * 50_000]
    got = {r.doc_id: r for r in score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), chain).collect()}
    for d, t in enumerate(texts):
        found, p = set(folded_words(t)), []
        for k in range(3):
            z = chain.bias[k] + sum(chain.weights[i, k] for w, i in (("bad", 0), ("worse", 1)) if w in found) + sum(chain.links[k, j] * p[j] for j in range(k))
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose([got[d].p_direct, got[d].p_repeated, got[d].p_toxic], p)
    # what a fold may not know doesn't reach its predictions
    rows, y, folds = [np.array([0])] * 20 + [np.array([1])] * 20, np.array([[1]] * 20 + [[0]] * 20), np.arange(40) % 2
    blind = train_chain(rows, y, folds, 2, np.array([[False, True], [False, True]]))[3]
    assert abs(blind[folds == 0] - 0.5).max() < 0.05 and abs(blind[folds == 1] - 0.5).max() > 0.2


# ---- decontamination


def least_edits(item, words):
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i + 1] + 1, new[i] + 1, row[i] + (x != w)))
        row, best = new, min(best, new[-1])
    return best


def test_matches_equal_edit_distances_of_all_pairs(spark):
    from feira.llm.decontaminate import ERROR_RATE, matches

    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(12)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 2, 3, 5, 7, 9, 14, 14, 21, 30)] + [None, "", "..."]
    texts = [None, ""]
    for _ in range(60):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(40))]
        if rng.random() < 0.7:
            own = (rng.choice(items[3:10])).split()
            for _ in range(rng.randrange(6)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], ["new"], [own[k], "more"]]) or own[k : k + 1][:0]
            w[len(w) // 2 : len(w) // 2] = own
        texts.append(", ".join(w).upper() if rng.random() < 0.3 else " ".join(w))
    want = set()
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            own = folded_words(item)
            edits = least_edits(own, folded_words(t)) if own else None
            if own and edits <= int(len(own) * ERROR_RATE):
                want.add((d, i, edits))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for block in (1_000_000, 20):
        assert {(r.doc_id, r.item_id, r.edits) for r in matches(docs, benchmark, block_words=block).collect()} == want


# ---- mixing


def plain_mix(rows, weights, total, max_epochs, seed=7):
    """doc_id -> epochs, by handing a budget down the tree; one domain."""
    weight = lambda level, name: weights.get(level, {}).get(name, weights.get(level, {}).get("*", 1.0))
    sizes = collections.defaultdict(lambda: collections.defaultdict(int))
    for d, t, lang, source, _ in rows:
        if weight("lang", lang or "") > 0 and weight("source", source or "") > 0:
            sizes[lang or ""][source or ""] += len(words_of(t))

    def fill(budget, caps, ws):
        open_, out = dict(caps), {}
        while open_ and budget > 1e-9:
            unit = budget / sum(ws[c] for c in open_)
            full = [c for c in open_ if open_[c] <= unit * ws[c]]
            if not full:
                return out | {c: unit * ws[c] for c in open_}
            for c in full:
                out[c] = open_.pop(c)
                budget -= out[c]
        return out | dict.fromkeys(open_, 0.0)

    langs = {x: sum(v.values()) * max_epochs for x, v in sizes.items() if sum(v.values())}
    chosen = collections.Counter()
    for lang, budget in fill(min(total, sum(langs.values())), langs, {x: weight("lang", x) for x in langs}).items():
        caps = {s: n * max_epochs for s, n in sizes[lang].items() if n}
        for source, part in fill(budget, caps, {s: weight("source", s) for s in caps}).items():
            part = int(part + 1e-6)
            whole, rest = divmod(part, sizes[lang][source])
            mine = [(hashlib.md5(f"{seed}:{whole}:{d}".encode()).hexdigest(), d, len(words_of(t))) for d, t, x, y, _ in rows if (x or "", y or "") == (lang, source)]
            before = 0
            for _, d, n in sorted(mine):
                chosen[d] += whole + (before < rest)
                before += n
    return +chosen


@pytest.mark.parametrize(
    ("weights", "total", "epochs"),
    [({"lang": {"en": 3}, "source": {"s0": 1, "*": 2}}, 900, 2), ({"lang": {"de": 1, "en": 0}}, 400, 2), ({"source": {"s0": 0, "s1": 0.5}, "lang": {"en": 4}}, 500, 1), ({}, 10**6, 3), ({}, 0, 2)],
)
def test_mix_equals_a_plain_tree(spark, weights, total, epochs):
    from feira.llm.mixing import mix

    rng = random.Random(total + epochs)
    rows = [(i, "w " * rng.randrange(30), rng.choice(["en", "de", None]), rng.choice(["s0", "s1", "s2"]), 0) for i in range(90)]
    got = mix(spark.createDataFrame(rows, SCHEMA), weights, total_tokens=total, max_epochs=epochs).collect()
    assert collections.Counter(r.doc_id for r in got) == plain_mix(rows, weights, total, epochs)


def test_a_branch_of_weight_0_is_no_capacity(spark):
    from feira.llm.mixing import mix

    rows = [(i, "w " * 10, "de" if i < 20 else "en", f"a{i % 2}", 0) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = mix(df, {"lang": {"de": 1, "en": 0}}, total_tokens=100, max_epochs=1, domain=F.col("source")).collect()
    assert len(got) == 10 and {r.lang for r in got} == {"de"}


# ---- awkward tables

CLASHES = {"WHOLE": 1, "cut": 2, "more": 3, "swaps": 4, "earlier": 5, "place": 6, "node": 7, "chunk": 8, "row_id": 9, "loose_id": 10, "h": 11, "own": 12, "piece": 13, "tokens": 14, "key": 15}
LONG = " ".join(f"w{i % 997}x{i % 31}" for i in range(40_000))


def awkward(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "src1", 0), (3, LONG, "en", "src1", len(LONG)), (3, LONG, "en", "src1", len(LONG)),
        (4, LONG, "de", "src2", len(LONG)), (None, LONG, "de", "src2", 1), (None, None, None, None, None), (5, "one", "en", "src0", 3),
        (6, "one", "en", "src0", 3), (7, "A b  c\nd\te", "en", "src3", 9), (8, "x" * 300_000, "en", "src3", 300_000), (5, "other text of the same id", "en", "src0", 9),
    ]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{v} as {k}" for k, v in CLASHES.items()]), rows


def operators(spark, labels, items):
    from feira.llm import decontaminate, license_scan, mixing, ngram_join, pii, quality, sharding, substring_dedup, token_store, toxicity

    return {
        "quality": (lambda d: quality.quality(d, labels), 12),
        "sharding": (lambda d: sharding.shard(d, 4), 12),
        "ngram_join": (ngram_join.near_duplicates, 12),
        "license_scan": (license_scan.scan, 12),
        "pii": (lambda d: pii.replace_entities(d, "k"), 12),
        "substring_dedup": (substring_dedup.dedup, 12),
        "toxicity": (lambda d: toxicity.toxicity(d, labels), 12),
        "token_store": (token_store.token_digest, 12),
        "decontaminate": (lambda d: decontaminate.clean(d, items), 12),
        "mixing": (lambda d: mixing.mix(d, total_tokens=10**9, max_epochs=1), 10)  # the leaf without a word has no capacity,
    }


@pytest.mark.parametrize("name", ["quality", "sharding", "ngram_join", "license_scan", "pii", "substring_dedup", "toxicity", "token_store", "decontaminate", "mixing"])
def test_operators_on_awkward_tables(spark, name):
    labels = spark.createDataFrame([(2, 1, 0), (3, 0, 1), (3, 1, 1), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(None, "one"), (1, None), (2, "")], "item_id long, text string")
    run, rows = operators(spark, labels, items)[name]
    docs, source = awkward(spark)
    got = run(docs).collect()
    assert len(got) == rows
    assert sorted(run(docs).collect(), key=repr) == sorted(got, key=repr)  # ties and repeated rows are settled alike
    if "text" in got[0] and name not in ("pii", "mixing"):
        assert collections.Counter((r.doc_id, r.text) for r in got) == collections.Counter(r[:2] for r in source)
    if name in ("sharding", "pii", "toxicity", "decontaminate", "mixing"):
        assert all(r[k] == v for r in got for k, v in CLASHES.items())  # the caller's columns stay
    assert run(docs.limit(0)).count() == 0


def test_keep_first_leaves_one_row_of_a_component(spark):
    from feira.llm.ngram_join import keep_first

    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, near), (1, near), (2, near + " tail"), (None, near), (None, near), (9, "other words stand in this text"), (None, "alone in the world here"), (None, "alone in the world here"), (7, None), (7, None), (8, "")]
    got = collections.Counter((r.doc_id, r.text) for r in keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sum(n for (d, t), n in got.items() if t and t.startswith("w0 ")) == 1
    assert got[9, rows[5][1]] == 1 and got[None, rows[6][1]] == 1 and got[7, None] == 1 and got[8, ""] == 1


def test_joined_sets_and_crowded_keys_change_nothing(spark, monkeypatch):
    from feira.llm import ngram_join

    rng = random.Random(12)
    base = [[f"{f}w{rng.randrange(50)}" for _ in range(40)] for f in range(6)]
    texts = []
    for i in range(240):
        w = list(base[i % 6])
        if i % 4:
            w[rng.randrange(40)] = f"new{i % 40}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = sorted(map(tuple, ngram_join.near_duplicates(df).collect()))
    monkeypatch.setattr(ngram_join, "MAX_CHOSEN", 0)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "crowded", lambda rows, key: rows.filter(f"{key} is not null").groupBy(key).count().filter("count > 2"))
    assert sorted(map(tuple, ngram_join.near_duplicates(df).collect())) == want


# ---- the pipeline


def write_tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import numpy as np
    from tokenizers import Tokenizer

    import corpus_pipeline
    from feira.llm import mixing
    from feira.llm.token_store import tokenizer_path

    rng = random.Random(3)
    item = " ".join(f"q{i}" for i in range(20))
    rows, labels = [], []
    for i in range(240):
        w = [f"v{rng.randrange(200)}" for _ in range(rng.randrange(8, 50))]
        if i % 6 == 0:
            w[3:3] = ["vile", "foul"][: 1 + i % 2]
        if i % 11 == 5:
            w[2:2] = item.split()[: 20 - i % 2]
        if i % 7 == 3 and rows:
            w = rows[-1][1].split() + (["tail"] if i % 2 else [])
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), f"src{i % 5}", 0))
        if i < 150:
            labels.append((i, 1, int("vile" in w)))
    folder = str(tmp_path)
    write_tables(spark, folder, rows, labels, [(1, item), (2, None)])
    got = {tuple(r) for r in corpus_pipeline.run(spark, f"file://{folder}").select("doc_id", "start", "n_tokens", "ids_crc32").collect()}

    kept = [r for r in rows if "vile" not in r[1].split()]
    sets = {r[0]: {tuple(w[k : k + 5]) for w in [words_of(r[1].lower())] for k in range(len(w) - 4)} for r in kept}
    low = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if low[b] < low[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a], changed = low[b], True
    kept = [r for r in kept if low[r[0]] == r[0]]
    kept = [r for r in kept if least_edits(item.split(), folded_words(r[1])) > 3]
    total = int(sum(len(words_of(r[1])) for r in kept) * 0.6)
    got_mix = collections.Counter(r.doc_id for r in mixing.mix(spark.createDataFrame(kept, SCHEMA), mixing.WEIGHTS, budget_share=0.6, max_epochs=1, domain=mixing.source_domain()).collect())
    assert total >= 0 and max(got_mix.values()) == 1
    tokenizer, start, want = Tokenizer.from_file(tokenizer_path()), 0, set()
    for d, t, *_ in kept:
        if got_mix[d]:
            ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
            want.add((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    assert got == want


def test_stages_on_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    docs, rows = awkward(spark)
    write_tables(spark, str(tmp_path), rows, [(2, 1, 0), (3, 0, 1)], [(1, None), (None, "one")])
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, f"file://{tmp_path}")
            n = out.count()
            assert n == 0 or name != "token_store" or n == len(rows), name
            if name != "token_store":
                assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
    empty = tmp_path / "empty"
    write_tables(spark, str(empty), [], [], [])
    assert corpus_pipeline.run(spark, f"file://{empty}").count() == 0
