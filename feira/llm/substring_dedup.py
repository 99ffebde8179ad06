"""Operator 6: substring dedup with a compressed FM-index per shard.

A word goes when it lies in a run of ``window`` words that also starts in a document of smaller doc_id. Shards are made
by content: each run of words has an anchor, the smallest hash of its ``k``-grams, so equal runs meet in one shard.

1. ``homes``: texts are packed to chunks of a few MB, compressed. From here on a row is a chunk or a packet of one.
2. ``repeated``: the anchors of each chunk, sorted, go to buckets of the hash range, which answer with a bit for each: is
   it met in a second document? Anchors that only one document has can't belong to a repeated run.
3. ``packets``: the pieces of text around repeated anchors, each distinct one of a chunk once, and their places.
4. ``ranges``: a shard puts its distinct pieces into one FM-index (wavelet matrix over the last column, sampled
   suffixes) and streams them through it. The backward search extends every run word by word for as long as it occurs
   twice: the matching statistics, up to the threshold. Runs that reach it report their interval of suffixes, and the
   smallest doc_id in the interval decides which places lose which words.
5. ``cut``: each chunk drops its ranges.

Only packed rows are shuffled, by chunk, bucket or shard; nothing is collected or broadcast. An anchor that very many
chunks share is split: its runs go to shards by their own hash, so no shard grows with it.

Edge cases: null and empty texts and texts shorter than the window keep all words; equal doc_ids aren't smaller than one
another; rows without doc_id keep all words and count for no other; repeated rows get equal results; an empty table
gives no rows; clashing extra columns are not read; a text of any length lies whole in one chunk. Words part at ASCII
white space, unchanged otherwise. Hashes only route: words are compared themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm.common import _MIX, mix64, plain_words, small_batches, table, word_hashes, written

WINDOW = 13
K = 6
#: Bytes of words in a chunk; a longer text has a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Anchors that one task compares.
BUCKET_ANCHORS = 2_000_000
#: Pieces (about 17 words each) that one FM-index is planned for.
SHARD_PIECES = 30_000
#: Chunks that share an anchor, from which its runs are dealt out by their own hash.
HOT = 64
#: Every so many words the FM-index knows the place of a suffix.
SAMPLE = 8

HOME = "chunk long, n_words long, ids binary, counts binary, body binary, doc_id long, n_own long, sha256 string"
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def packed(array: np.ndarray) -> bytes:
    import pyarrow as pa

    raw = np.ascontiguousarray(array)
    return len(raw.tobytes()).to_bytes(8, "little") + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), kind)


def sha256(raw: bytes | np.ndarray) -> str:
    return hashlib.sha256(raw).hexdigest()


def homes(docs: DataFrame, window: int, chunk_bytes: int) -> DataFrame:
    """HOME: a row for each chunk, and a row (doc_id, n_own, sha256) for each document that can't lose a word."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId() << 32, 0
        names = [c.split()[0] for c in HOME.split(", ")]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        held: list[tuple[int, int, np.ndarray]] = []

        def chunk():
            nonlocal number, held
            ids, counts, bodies = zip(*held, strict=True)
            row = (part + number, sum(counts), packed(np.array(ids, "<i8")), packed(np.array(counts, "<u4")), packed(np.concatenate(bodies)), None, None, None)
            number, held = number + 1, []
            return batch([row])

        size = 0
        for b in batches:
            body, after, before = plain_words(b.column("text"))
            at = np.append(0, after + 1)[before]
            out = []
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                n, own = int(before[i + 1] - before[i]), body[at[i] : at[i + 1]]
                if d is None or n < window:
                    out.append((None, None, None, None, None, d, n, sha256(own[:-1])))
                    continue
                if held and size + len(own) > chunk_bytes:
                    yield chunk()
                    size = 0
                held.append((d, n, own))
                size += len(own)
            if out:
                yield batch(out)
            held = [(d, n, own.copy()) for d, n, own in held]  # not the whole batch they lie in
        if held:
            yield chunk()

    return written(docs.mapInArrow(run, HOME), "dedup-homes")


class Chunk:
    """The documents of a chunk, and its runs of windows with one anchor."""

    def __init__(self, ids: bytes, counts: bytes, body: bytes):
        self.ids, self.counts = unpacked(ids, "<i8"), unpacked(counts, "<u4").astype(np.int64)
        self.body = unpacked(body, np.uint8)
        self.after = np.flatnonzero(self.body == 32)

    def bytes_of(self, first: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``words`` words begin and end in the body (the last word's space excluded)."""
        return np.append(0, self.after + 1)[first], self.after[first + words - 1]

    def runs(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, windows, anchor and document (place in ``ids``) of each run."""
        h = word_hashes(self.body, self.after)
        m = len(h) - k + 1
        grams = np.zeros(m, np.uint64)
        for j in range(k):
            grams += h[j : j + m] * np.uint64((_MIX * (2 * j + 1) | 1) % (1 << 64))
        grams = mix64(grams)
        n = len(h) - window + 1
        least = grams[:n].copy()
        for j in range(1, window - k + 1):
            np.minimum(least, grams[j : j + n], out=least)
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        at = np.flatnonzero(doc[:n] == doc[window - 1 :])
        least = least[at]
        new = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (np.diff(at) > 1)]))
        return at[new], np.diff(np.append(new, len(at))), least[new], doc[at[new]]

    def anchors(self, window: int, k: int):
        """The runs; their distinct anchors in order; each run's anchor among them; and which of them two doc_ids share."""
        first, windows, anchor, doc = self.runs(window, k)
        own, which = np.unique(anchor, return_inverse=True)
        least, most = np.full(len(own), np.iinfo(np.int64).max), np.full(len(own), np.iinfo(np.int64).min)
        np.minimum.at(least, which, self.ids[doc])
        np.maximum.at(most, which, self.ids[doc])
        return (first, windows, anchor, doc), own, which, least < most


def _slot(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal parts of the hash range."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def repeated(home: DataFrame, buckets: int, window: int, k: int) -> DataFrame:
    """(chunk, bucket, n_repeated, flags): of each chunk's anchors in a bucket, in order, which two documents share, and
    which HOT chunks or more do (two rows of packed bits)."""

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for c, *parts in zip(*(b.column(x).to_pylist() for x in ("chunk", "ids", "counts", "body")), strict=True):
                _, own, _, shared = Chunk(*parts).anchors(window, k)
                cuts = np.searchsorted(_slot(own, buckets), np.arange(buckets + 1))
                filled = np.flatnonzero(np.diff(cuts)).tolist()
                six = own.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]  # the upper 48 bits: a chance match only adds a candidate
                payload = [np.packbits(shared[cuts[x] : cuts[x + 1]]).tobytes() + six[cuts[x] : cuts[x + 1]].tobytes() for x in filled]
                sizes = np.diff(cuts)[filled]
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(filled, pa.int32()), "chunk": pa.array([c] * len(filled), pa.int64()), "n": pa.array(sizes, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def compare(batches):
        import pyarrow as pa

        chunks, bucket, sizes, flags, keys = [], [], [], [], []
        for b in batches:
            chunks += b.column("chunk").to_pylist()
            bucket += b.column("bucket").to_pylist()
            for n, raw in zip(b.column("n").to_pylist(), b.column("payload").to_pylist(), strict=True):
                skip = -(-n // 8)
                eight = np.zeros((n, 8), np.uint8)
                eight[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, skip).reshape(n, 6)
                sizes.append(n)
                keys.append(eight.view("<u8").ravel())
                flags.append(np.unpackbits(np.frombuffer(raw, np.uint8, skip), count=n).astype(bool))
        if not sizes:
            return
        keys, flags = np.concatenate(keys), np.concatenate(flags)
        order = np.argsort(keys)
        starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
        many = np.diff(np.append(starts, len(keys)))
        shared = np.zeros(len(keys), bool)
        shared[order] = np.repeat((many > 1) | np.logical_or.reduceat(flags[order], starts), many)
        hot = np.zeros(len(keys), bool)
        hot[order] = np.repeat(many >= HOT, many)
        ends = np.cumsum(sizes).tolist()
        rows = [(c, x, int(shared[e - n : e].sum()), np.packbits(np.stack([shared[e - n : e], hot[e - n : e]]), axis=1).tobytes()) for c, x, n, e in zip(chunks, bucket, sizes, ends, strict=True)]
        rows = [r for r in rows if r[2]]
        if rows:
            c, x, n, f = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(c, pa.int64()), "bucket": pa.array(x, pa.int32()), "n_repeated": pa.array(n, pa.int32()), "flags": pa.array(f, pa.binary())})

    sent = home.select("chunk", "ids", "counts", "body").mapInArrow(send, "bucket int, chunk long, n int, payload binary")
    return written(sent.repartitionById(buckets, "bucket").mapInArrow(compare, "chunk long, bucket int, n_repeated int, flags binary"), "dedup-repeated")


def packets(home: DataFrame, found: DataFrame, buckets: int, shards: int, window: int, k: int) -> DataFrame:
    """(shard, chunk, sizes, owners, words, piece, first, docs): the distinct pieces of a chunk for a shard (words each,
    smallest doc_id, bytes), and the places of pieces (which one, first word, doc_id)."""
    answers = found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "flags")).alias("answers"))

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        names = ("shard", "chunk", "sizes", "owners", "words", "piece", "first", "docs")
        kinds = (pa.int32(), pa.int64(), *(pa.binary(),) * 6)
        for b in batches:
            for c, answers, *parts in zip(*(b.column(x).to_pylist() for x in ("chunk", "answers", "ids", "counts", "body")), strict=True):
                chunk = Chunk(*parts)
                (first, windows, anchor, doc), own, which, _ = chunk.anchors(window, k)
                cuts = np.searchsorted(_slot(own, buckets), np.arange(buckets + 1))
                flags = np.zeros((2, len(own)), bool)
                for a in answers:
                    low, high = cuts[a["bucket"]], cuts[a["bucket"] + 1]
                    flags[:, low:high] = np.unpackbits(np.frombuffer(a["flags"], np.uint8).reshape(2, -1), axis=1, count=high - low).astype(bool)
                mine = np.flatnonzero(flags[0, which])
                hot = flags[1, which[mine]]
                times = np.where(hot, windows[mine], 1)  # runs of hot anchors go one by one
                step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                words = np.repeat(np.where(hot, window, windows[mine] + window - 1), times)
                at, docs = np.repeat(first[mine], times) + step, chunk.ids[np.repeat(doc[mine], times)]
                low, high = chunk.bytes_of(at, words)
                raw = chunk.body.tobytes()
                pieces = [raw[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)]
                known: dict[bytes, int] = {}
                piece = np.fromiter((known.setdefault(p, len(known)) for p in pieces), np.int64, len(pieces))
                owner = np.full(len(known), np.iinfo(np.int64).max)
                np.minimum.at(owner, piece, docs)
                one = np.zeros(len(known), np.int64)
                one[piece] = np.arange(len(piece))
                distinct, hot, route = list(known), np.repeat(hot, times)[one], np.repeat(anchor[mine], times)[one]
                alone = np.flatnonzero(hot)
                route[alone] = np.fromiter((xxh3_64_intdigest(distinct[i]) for i in alone.tolist()), np.uint64, len(alone))
                shard = _slot(route, shards)
                order = np.argsort(shard, kind="stable")
                place_shard = shard[piece]
                by_place = np.argsort(place_shard, kind="stable")
                local = np.zeros(len(known), np.int64)
                piece_cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                place_cuts = np.searchsorted(place_shard[by_place], np.arange(shards + 1))
                local[order] = np.arange(len(order)) - piece_cuts[shard[order]]
                rows = []
                for s in np.flatnonzero(np.diff(piece_cuts)).tolist():
                    ps, ls = order[piece_cuts[s] : piece_cuts[s + 1]], by_place[place_cuts[s] : place_cuts[s + 1]]
                    body = np.frombuffer(b" ".join([distinct[i] for i in ps.tolist()]) + b" ", np.uint8)
                    rows.append((s, c, packed(words[one[ps]].astype("<u4")), packed(owner[ps]), packed(body), packed(local[piece[ls]].astype("<u4")), packed(at[ls].astype("<u4")), packed(docs[ls])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

    near = home.select("chunk", "ids", "counts", "body").join(answers, "chunk").select("chunk", "answers", "ids", "counts", "body")
    return near.mapInArrow(run, "shard int, chunk long, sizes binary, owners binary, words binary, piece binary, first binary, docs binary")


class WaveletMatrix:
    """Bit planes of a sequence, packed, with counts before every 64 bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.planes, self.counts, self.zeros, self.bits = [], [], [], bits
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            plane, counts = bit_counts(bit.astype(bool))
            self.planes.append(plane)
            self.counts.append(counts)
            self.zeros.append(len(symbols) - int(counts[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.begins = self._walk(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = ones_before(self.planes[level], self.counts[level], at)
            bit = ((symbols >> (self.bits - 1 - level)) & 1).astype(bool)
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return at

    def before(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before its place."""
        return self._walk(symbols, at) - self.begins[symbols]

    def symbols(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at places, and how often each occurs before."""
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            plane, counts = self.planes[level], self.counts[level]
            bit = (plane[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            ones = ones_before(plane, counts, at)
            out = out << 1 | bit.astype(np.int64)
            at = np.where(bit.astype(bool), self.zeros[level] + ones, at - ones)
        return out, at - self.begins[out]


def bit_counts(bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = np.packbits(bit, bitorder="little")
    plane = np.zeros(len(bit) // 64 + 1, np.uint64)
    plane.view(np.uint8)[: len(raw)] = raw
    counts = np.zeros(len(plane) + 1, np.uint32)
    np.cumsum(np.bitwise_count(plane), out=counts[1:])
    return plane, counts


def ones_before(plane: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    word = at >> 6
    mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
    return counts[word].astype(np.int64) + np.bitwise_count(plane[word] & mask)


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Where the suffixes begin, in order, by doubling: each round sorts only those that tie so far."""
    n = len(sequence)
    counts = np.bincount(sequence)
    rank = (np.cumsum(counts) - counts)[sequence].astype(np.int64)  # suffixes before those that tie with this one
    open_, step = np.flatnonzero(counts[sequence] > 1), 1
    while len(open_):
        ahead = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + ahead
        by = np.argsort(key)
        open_, key = open_[by], key[by]
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(True, rank[open_[1:]] != rank[open_[:-1]])
        at = np.arange(len(open_))
        inside = at - np.maximum.accumulate(np.where(group, at, 0))  # place in the old group
        rank[open_] = rank[open_] + np.maximum.accumulate(np.where(new, at, 0)) - at + inside
        open_ = open_[~(new & np.append(new[1:], True))]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Compressed index of word numbers (1 and up; 0 parts pieces and ends the sequence), for patterns of up to 16 words:
    a wavelet matrix of the last column, and the places of every SAMPLE-th word's suffix."""

    def __init__(self, sequence: np.ndarray):
        order = suffix_order(sequence)
        last = sequence[order - 1]
        bits = max(1, int(sequence.max(initial=0)).bit_length())
        self.matrix = WaveletMatrix(last.astype(np.int64), bits)
        self.counts = np.bincount(sequence, minlength=1 << bits)
        self.starts = np.cumsum(self.counts) - self.counts
        sampled = (order % SAMPLE == 0) | (last == 0)  # a walk never passes the start of a piece
        self.marks, self.mark_counts = bit_counts(sampled)
        self.samples = order[sampled].astype(np.int32)

    def matching_statistics(self, stream: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of ``ends`` in a stream of word numbers, the longest run ending there (of up to ``most`` words)
        that the index holds twice or more, and its interval of suffixes."""
        word = stream[ends]
        low, high = self.starts[word], self.starts[word] + self.counts[word]
        length = (high - low > 1).astype(np.int64)
        alive = np.flatnonzero(length)
        for back in range(1, most):
            word = stream[ends[alive] - back]
            a = self.starts[word] + self.matrix.before(word, low[alive])
            b = self.starts[word] + self.matrix.before(word, high[alive])
            many = (b - a > 1) & (word > 0)
            alive = alive[many]
            low[alive], high[alive] = a[many], b[many]
            length[alive] += 1
        return length, low, high

    def places(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of ``rows`` begin: back word by word to a sampled one."""
        out, steps, left, at = np.zeros(len(rows), np.int64), 0, np.arange(len(rows)), rows
        while len(left):
            marked = ((self.marks[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
            out[left[marked]] = self.samples[ones_before(self.marks, self.mark_counts, at[marked])] + steps
            left, at = left[~marked], at[~marked]
            word, before = self.matrix.symbols(at)
            at, steps = self.starts[word] + before, steps + 1
        return out


def smallest_owners(pieces: list[bytes], owners: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest doc_id of every run of the pieces, one piece after another, and each piece's runs."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pa.array([b" ".join(pieces)], pa.large_binary())
    numbers = pc.split_pattern(text.cast(pa.large_string()), " ").flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    sizes = np.fromiter((p.count(b" ") + 1 for p in pieces), np.int64, len(pieces))
    firsts = np.cumsum(sizes + 1) - sizes - 1
    sequence = np.zeros(len(numbers) + len(pieces), np.int64)
    inside = np.ones(len(sequence), bool)
    inside[firsts + sizes] = False
    sequence[inside] = numbers
    runs = sizes - window + 1
    at = np.repeat(firsts - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
    least = np.repeat(owners, runs)
    index = FMIndex(sequence)
    length, low, high = index.matching_statistics(sequence, at + window - 1, window)
    hit = np.flatnonzero(length == window)
    if len(hit):
        bounds, one, which = np.unique(low[hit], return_index=True, return_inverse=True)  # equal runs have one interval, others are disjoint
        size = (high - low)[hit][one]
        rows = np.repeat(bounds - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        held = owners[np.searchsorted(firsts, index.places(rows), "right") - 1]
        least[hit] = np.minimum.reduceat(held, np.cumsum(size) - size)[which]
    return least, runs


def ranges(sent: DataFrame, shards: int, window: int) -> DataFrame:
    """(chunk, low, high): word ranges of a chunk that go, from one FM-index for each shard."""

    def search(batches):
        import pyarrow as pa

        known: dict[bytes, int] = {}
        least: list[np.ndarray] = []
        held = []
        for b in batches:
            for c, sizes, owners, words, *places in zip(*(b.column(x).to_pylist() for x in ("chunk", "sizes", "owners", "words", "piece", "first", "docs")), strict=True):
                body = unpacked(words, np.uint8)
                after = np.flatnonzero(body == 32)[np.cumsum(unpacked(sizes, "<u4"), dtype=np.int64) - 1].tolist()
                raw, at, mine = body.tobytes(), 0, []
                for end in after:
                    mine.append(known.setdefault(raw[at:end], len(known)))
                    at = end + 1
                held.append((c, np.array(mine), places))
                least.append(unpacked(owners, "<i8"))
        if not known:
            return
        owner = np.full(len(known), np.iinfo(np.int64).max)
        np.minimum.at(owner, np.concatenate([m for _, m, _ in held]), np.concatenate(least))
        run_owner, runs = smallest_owners(list(known), owner, window)
        run_at = np.cumsum(runs) - runs
        for c, mine, (piece, first, docs) in held:
            piece, first, docs = mine[unpacked(piece, "<u4")], unpacked(first, "<u4").astype(np.int64), unpacked(docs, "<i8")
            n = runs[piece]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            gone = run_owner[np.repeat(run_at[piece], n) + step] < np.repeat(docs, n)
            at = np.unique((np.repeat(first, n) + step)[gone])
            if len(at):
                new = np.flatnonzero(np.append(True, np.diff(at) > 1))
                low, high = at[new], at[np.append(new[1:] - 1, len(at) - 1)] + window
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int64()), "low": pa.array([packed(low.astype("<u4"))], pa.binary()), "high": pa.array([packed(high.astype("<u4"))], pa.binary())})

    return sent.repartitionById(shards, "shard").mapInArrow(search, "chunk long, low binary, high binary")


def cut(home: DataFrame, found: DataFrame, with_text: bool) -> DataFrame:
    """DIGEST of every document of ``home``; with_text: also kept_text."""
    gone = found.groupBy("chunk").agg(F.collect_list(F.struct("low", "high")).alias("gone"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for gone, *parts in zip(*(b.column(x).to_pylist() for x in ("gone", "ids", "counts", "body")), strict=True):
                chunk = Chunk(*parts)
                n = len(chunk.after)
                edge = np.zeros(n + 1, np.int64)
                for g in gone or ():
                    edge += np.bincount(unpacked(g["low"], "<u4"), minlength=n + 1) - np.bincount(unpacked(g["high"], "<u4"), minlength=n + 1)
                keep = np.cumsum(edge[:-1]) == 0
                size = np.diff(np.append(-1, chunk.after))
                body = chunk.body[np.repeat(keep, size)] if not keep.all() else chunk.body
                ends = np.cumsum(chunk.counts)
                kept = np.add.reduceat(keep.astype(np.int64), ends - chunk.counts)
                high = np.append(0, np.cumsum(size * keep))[ends].tolist()
                low = [0, *high[:-1]]
                raw = memoryview(body.tobytes())
                texts = [raw[x : max(x, y - 1)] for x, y in zip(low, high, strict=True)]
                columns = {"doc_id": pa.array(chunk.ids), "n_words": pa.array(chunk.counts), "n_removed": pa.array(chunk.counts - kept), "kept_sha256": pa.array([sha256(t) for t in texts], pa.string())}
                if with_text:
                    columns["kept_text"] = pa.array([str(t, "utf-8") for t in texts], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    near = home.select("chunk", "ids", "counts", "body").join(gone, "chunk", "left").select("gone", "ids", "counts", "body")
    return near.mapInArrow(run, DIGEST + (", kept_text string" if with_text else ""))


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; with_text: also kept_text, the kept words joined by one
    space (null where no word could go: the text stays as it is)."""
    if not k < window <= 16:
        raise ValueError("the window must be longer than k and at most 16 words")
    small_batches(docs.sparkSession)
    home = homes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, chunk_bytes)
    short = home.filter("chunk is null").select("doc_id", F.col("n_own").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    home = home.filter("chunk is not null").drop("doc_id", "n_own", "sha256")
    words = home.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-words // (4 * BUCKET_ANCHORS)))  # a new anchor every four to five words
    found = repeated(home, buckets, window, k)
    pieces = found.agg(F.coalesce(F.sum("n_repeated"), F.lit(0))).first()[0]
    shards = max(1, -(-pieces // SHARD_PIECES))
    out = cut(home, ranges(packets(home, found, buckets, shards, window, k), shards, window), with_text)
    return out.unionByName(short, allowMissingColumns=True)


def op6_substring_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op6_substring_dedup": op6_substring_dedup}
