"""Operator 13: BPE encoding and decoding through tables of distinct words and of pieces.

Encoding: texts are split into words in Spark and gathered in packets of whole documents. A packet holds a code for each
word, in order, and its distinct words once. The words of all packets are dealt by word, each distinct one is encoded once
by the tokenizer, and its ids join the packets again, where they go to the places of their codes.

Decoding: the distinct ids of a packet join the table of pieces by id, and the pieces go to the places of the ids and of the
codes in the same way. No row is made for each id of a word, as a task's rows then outgrow its memory.

Words are parted where a byte-level pattern always parts: between a character that is no white space of any kind and an
ASCII white space after it, and between a letter and an ASCII mark (no apostrophe) after it, but never within an added token. So a
word's ids don't depend on its neighbours and the tokenizer's own pattern does the rest within it. Tokenizers of another
kind (a normaliser, no byte level, added tokens that take white space with them) are given each text as one word.

Scale: codes are 2 or 4 bytes a word, compressed, and stored once, bucketed by packet, so they don't move again; a word
moves once a packet however often it stands in it; the table of pieces is as long as the tokenizer's vocabulary (refused
above MAX_PIECES), so it is broadcast. Groups are packets, which are as large as PACKET_BYTES or one document.

Edge cases: null and empty texts have no ids and decode to an empty text; null ids likewise; texts and words of any length
are encoded whole; repeated rows and null doc_ids keep their rows; ids without a piece add nothing; bytes that are no UTF-8 become
U+FFFD; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.llm.common import shared_folder, small_batches, table

#: Bytes of text of a packet.
PACKET_BYTES = 12 << 20
#: Words of packets that are dealt to one task.
DEALT_WORDS = 1_000_000
#: Words given to the tokenizer at once.
ENCODED_AT_ONCE = 4096
#: Pieces of a vocabulary that may be broadcast.
MAX_PIECES = 4_000_000

PACKET = "packet long, doc_ids array<long>, ends array<long>, codes binary, wide boolean, entries array<binary>"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(path: str):
    """The tokenizer without truncation and padding, and its description."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, json.loads(tokenizer.to_str())


def in_words(path: str) -> bool:
    """Whether words may be encoded apart: byte level by its own pattern, added tokens that stand for themselves."""
    made = _open(path)[1]
    before = made.get("pre_tokenizer") or {}
    plain = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or any(c.isspace() for c in t["content"]) for t in made.get("added_tokens", ()))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CONTROL = _BLANK.copy()
_CONTROL[28:32] = True
_LETTER = np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
#: Second bytes of the letters U+00C0 to U+00FF, all but the two signs among them.
_LATIN = np.zeros(256, bool)
_LATIN[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True


def word_starts(x: np.ndarray) -> np.ndarray:
    """Places of UTF-8 bytes ``x`` at which a word begins: an ASCII white space after a character that is no white space
    of Unicode (a few other separators aren't parted from what follows either, which changes nothing), and an ASCII mark
    after a letter (of Latin-1; after others it isn't parted)."""
    back = np.concatenate([np.zeros(3, np.uint8), x])
    a, b, c = back[:-3], back[1:-2], back[2:-1]  # the third, second and first byte before each place
    space = _CONTROL[c] | ((b == 0xC2) & ((c == 0x85) | (c == 0xA0)))
    space |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F) & (c <= 0xA4)))
    space |= ((a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
    letter = _LETTER[c] | ((b == 0xC3) & _LATIN[c])
    return np.flatnonzero((_BLANK[x] & ~space) | (_MARK[x] & letter))


def _whole(cuts: np.ndarray, text, tokens: list[bytes]) -> np.ndarray:
    """``cuts`` without those within an occurrence of one of ``tokens``."""
    for token in tokens:
        for found in re.finditer(b"(?=" + re.escape(token) + b")", text):
            at = found.start()
            cuts = np.delete(cuts, np.s_[np.searchsorted(cuts, at, "right") : np.searchsorted(cuts, at + len(token))])
    return cuts


def _split(column, apart: bool, tokens: list[bytes]):
    """Words of an Arrow column of texts as one binary array, and the words up to each text's end."""
    import pyarrow as pa
    import pyarrow.compute as pc

    raw = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(raw).to_numpy()).astype(np.int32)  # a batch, and so a text, is under 2 GB
    begins = np.append(np.int32(0), ends[:-1])
    buffer = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), raw), pa.scalar(b"", pa.large_binary()))[0].as_buffer()
    del raw
    cuts = begins[ends > begins]
    if apart and len(cuts):
        x = np.frombuffer(buffer, np.uint8)
        step, found = 1 << 20, []  # a part at a time, with the three bytes before it
        for k in range(0, len(x), step):
            back = min(k, 3)
            part = word_starts(x[k - back : k + step])
            found.append((part[part >= back] + (k - back)).astype(np.int32))
        cuts = np.concatenate([cuts, _whole(np.concatenate(found), buffer, tokens)])
        del found
        cuts.sort()
        cuts = cuts[np.diff(cuts, prepend=np.int32(-1)) > 0]
    offsets = np.append(cuts, ends[-1:] if len(ends) else np.zeros(1, np.int32))
    words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), buffer])
    return words, np.searchsorted(cuts, ends)


def _packed(codes: np.ndarray, wide: bool) -> bytes:
    """Codes with their bytes apart, compressed."""
    import pyarrow as pa

    planes = np.ascontiguousarray(codes.astype("<u4" if wide else "<u2", copy=False).view(np.uint8).reshape(len(codes), 4 if wide else 2).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes, wide: bool) -> np.ndarray:
    import pyarrow as pa

    n, width = int.from_bytes(packed[:8], "little"), 4 if wide else 2
    raw = pa.decompress(packed[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view("<u4" if wide else "<u2").ravel()


def _bundle(words) -> bytes:
    """An Arrow binary array as one compressed piece."""
    import pyarrow as pa

    sizes, data = _parts(words)
    lengths = _packed(np.diff(sizes), True)
    raw = np.frombuffer(data, np.uint8)[sizes[0] : sizes[-1]].tobytes()
    return len(lengths).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + lengths + pa.compress(raw, "zstd", asbytes=True)


def _unbundled(bundle: bytes):
    import pyarrow as pa

    head, size = int.from_bytes(bundle[:8], "little"), int.from_bytes(bundle[8:16], "little")
    offsets = np.append(0, np.cumsum(_unpacked(bundle[16 : 16 + head], True), dtype=np.int64)).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(pa.decompress(bundle[16 + head :], size, "zstd", asbytes=True))])


def _parts(column):
    """Offsets and bytes of an Arrow binary array without nulls."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    return np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset), column.buffers()[2] or b""


def _joined(batches, most: int):
    """Batches parted and put together to about ``most`` bytes, whole rows each."""
    import pyarrow as pa

    def parted(batch):
        if batch.nbytes <= most or batch.num_rows < 2:
            return [batch]
        half = batch.num_rows // 2
        return parted(batch.slice(0, half)) + parted(batch.slice(half))

    held, size = [], 0
    for batch in (part for whole in batches for part in parted(whole)):
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _packets(rows: DataFrame, split, name: str) -> DataFrame:
    """Packets of ``rows`` (doc_id and one more column), written in the shared folder and bucketed by packet. split(column): an
    Arrow array of all entries in order, and the entries up to the end of each row."""

    def gather(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in _joined(batches, PACKET_BYTES):
            entries, ends = split(batch.column(1))
            coded = entries.dictionary_encode()
            del entries
            codes, distinct = coded.indices.to_numpy(), coded.dictionary
            often = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")  # low codes for frequent words
            wide = len(distinct) > 1 << 16
            rank = np.empty(len(distinct), np.uint32 if wide else np.uint16)
            rank[often] = np.arange(len(distinct))
            yield pa.RecordBatch.from_pydict(
                {
                    "packet": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                    "ends": pa.array([ends.tolist()], pa.list_(pa.int64())),
                    "codes": [_packed(rank[codes], wide)],
                    "wide": [wide],
                    "entries": pa.array([distinct.take(pa.array(often)).cast(pa.binary()).to_pylist()], pa.list_(pa.binary())),
                }
            )
            number += 1
            del coded, codes, distinct, rank
            pa.default_memory_pool().release_unused()

    spark = rows.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.mapInArrow(gather, PACKET).write.bucketBy(buckets, "packet").option("path", f"{shared_folder(spark)}/{made}").option("compression", "zstd")
    found.saveAsTable(made)
    return spark.table(made)


def _entries(packets: DataFrame) -> DataFrame:
    return packets.select(F.col("packet").alias("packet"), "entries")  # a column of its own, as the entries meet their packets again


def split_words(docs: DataFrame, path: str) -> DataFrame:
    """Packets of the words of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    apart, added = in_words(path), [t["content"].encode() for t in _open(path)[1].get("added_tokens", ()) if t["content"]]
    return _packets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda column: _split(column, apart, added), "bpe_words")


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, piece: the bytes of each id of the vocabulary."""
    tokenizer, made = _open(path)
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    if len(vocabulary) > MAX_PIECES:
        raise ValueError(f"a vocabulary of {len(vocabulary)} pieces is too long to broadcast")
    # The byte-level alphabet (fixed): printable Latin-1 characters stand for themselves, the other bytes for U+0100 and on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    added = {t["content"] for t in made.get("added_tokens", ())}
    level = (made.get("decoder") or {}).get("type") == "ByteLevel"

    def spelled(piece: str) -> bytes:
        if level and all(c in byte_of for c in piece):
            return bytes(byte_of[c] for c in piece)
        if level or piece in added:
            return piece.encode()
        raise ValueError("pieces are spelled for byte-level tokenizers only")

    return spark.createDataFrame([(i, bytearray(spelled(p))) for p, i in vocabulary.items()], "id int, piece binary")


def part_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts


def encode_entries(entries: DataFrame, path: str) -> tuple[DataFrame, int]:
    """packet, part, sizes, ids of packets' words (packet, entries): for the words of a packet in a part, in order of their codes,
    how many ids each has, and all their ids, as array<short> (unsigned) where the vocabulary allows it. And how many parts
    there are: a word's part is ``part_of`` it.

    Words are dealt by their hash, in one row for all words of a packet that go to one task, so a task has all
    occurrences of its words and encodes each distinct one once.
    """
    spark = entries.sparkSession
    words = entries.agg(F.sum(F.size("entries"))).first()[0] or 0
    kind = "short" if _open(path)[0].get_vocab_size(with_added_tokens=True) <= 1 << 16 else "int"
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // DEALT_WORDS))

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for packet, own in zip(batch.column("packet").to_pylist(), batch.column("entries"), strict=True):
                own = own.values
                if not len(own):
                    continue
                part = part_of(own.to_pylist(), parts)
                order = np.argsort(part, kind="stable")
                at = np.flatnonzero(np.diff(part[order], prepend=-1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(part[order][at], pa.int32()),
                        "packet": pa.array(np.full(len(at), packet), pa.int64()),
                        "words": [_bundle(own.take(pa.array(x))) for x in np.split(order, at[1:])],
                    }
                )

    def encode(batches):
        import pyarrow as pa

        tokenizer, known = _open(path)[0], {}
        for batch in batches:
            bundles = [_unbundled(x) for x in batch.column("words").to_pylist()]
            own = pa.concat_arrays(bundles).dictionary_encode()
            words = own.dictionary.to_pylist()
            new = [w for w in words if w not in known]
            for k in range(0, len(new), ENCODED_AT_ONCE):
                some = new[k : k + ENCODED_AT_ONCE]
                known.update(zip(some, (np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)), strict=True))
            ids = pa.array([known[w] for w in words], pa.list_(pa.int32())).take(own.indices)
            by_word = np.append(0, np.cumsum([len(x) for x in bundles])).astype(np.int32)
            ends = np.asarray(ids.offsets)
            flat = ids.flatten().to_numpy().astype(np.uint16 if kind == "short" else np.uint32)
            lists = [
                pa.ListArray.from_arrays(pa.array(by_word), pa.array(np.diff(ends), pa.int32())),
                pa.ListArray.from_arrays(pa.array(ends[by_word]), pa.array(flat.view(np.int16 if kind == "short" else np.int32))),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("packet"), batch.column("part"), *lists], ["packet", "part", "sizes", "ids"])

    dealt = entries.mapInArrow(deal, "part int, packet long, words binary").repartitionById(parts, "part")
    return dealt.mapInArrow(encode, f"packet long, part int, sizes array<int>, ids array<{kind}>"), parts


def _array(sizes: np.ndarray, data):
    """Values of the given sizes, one after another in ``data``, as an Arrow array."""
    import pyarrow as pa

    offsets = np.append(0, np.cumsum(sizes, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _laid_out(values, codes: np.ndarray, ends: np.ndarray) -> Iterator[memoryview]:
    """For each row, one at a time, the values of its codes one after another."""
    import pyarrow as pa

    begin, step = 0, 1 << 18  # some rows at a time
    while begin < len(ends):
        first = int(ends[begin - 1]) if begin else 0
        last = max(begin + 1, int(np.searchsorted(ends, first + step, "right")))
        found = values.take(pa.array(codes[first : int(ends[last - 1])]))
        at, data = _parts(found)
        rows = [0, *at[ends[begin:last] - first].tolist()]
        yield from map(memoryview(data).__getitem__, map(slice, rows, rows[1:]))
        begin = last


def _by_code(known, entries, parts: int):
    """The ids of a packet's words from the rows of ``encode_entries``: the words' codes in the order of the ids, how many
    ids each word has, and all ids."""
    import pyarrow as pa
    import pyarrow.compute as pc

    part = part_of(entries.to_pylist(), parts)
    order = np.argsort(part, kind="stable").astype(np.int32)
    rows = known.combine_chunks()
    rows = rows.take(pa.array(np.argsort(rows.column("part").to_numpy(), kind="stable")))
    sizes, ids = (pc.list_flatten(rows.column(c)).combine_chunks() for c in ("sizes", "ids"))
    ids = ids.to_numpy()
    return order, sizes.to_numpy(), ids.view(np.uint16 if ids.dtype == np.int16 else np.uint32)


def _in_code_order(order: np.ndarray, sizes: np.ndarray, data: np.ndarray):
    """Values of words in ``order`` of codes (sizes in items of ``data``) as an Arrow array with a value for each code."""
    import pyarrow as pa

    turn = np.empty(len(order), np.int32)
    turn[order] = np.arange(len(order), dtype=np.int32)
    return _array(sizes.astype(np.int64) * data.itemsize, data).take(pa.array(turn))


def _by_position(packets: DataFrame, values: DataFrame, schema: str, assemble) -> DataFrame:
    """Rows of documents from packets and the values of their entries (packet, ...): both meet by packet.

    assemble(values, the packet's entries, codes of its words, ends of its documents): the columns of ``schema`` but doc_id, by name.
    """

    def build(own, values):
        import pyarrow as pa

        made = []
        for row in own.to_batches():
            for k in range(row.num_rows):
                codes = _unpacked(row.column("codes")[k].as_py(), row.column("wide")[k].as_py())
                made.append(pa.table({"doc_id": row.column("doc_ids")[k].values, **assemble(values, row.column("entries")[k].values, codes, row.column("ends")[k].values.to_numpy())}))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(made)

    return packets.groupBy("packet").cogroup(values.groupBy("packet")).applyInArrow(build, schema)


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of each row of ``docs`` (doc_id, text), as the tokenizer encodes the whole text without
    special tokens. tokenizer: path of a file for the tokenizers library."""
    path = tokenizer or tokenizer_path()
    packets = split_words(docs, path)

    known, parts = encode_entries(_entries(packets), path)

    def rows(values, entries, codes, ends):
        import pyarrow as pa

        order, sizes, ids = _by_code(values, entries, parts)
        found = _laid_out(_in_code_order(order, sizes, ids.astype("<u4")), codes, ends)
        return {"ids": pa.array([np.frombuffer(r, "<i4") for r in found], pa.list_(pa.int32()))}

    return _by_position(packets, known, "doc_id long, ids array<int>", rows)


def _with_own_pieces(known: DataFrame, path: str) -> DataFrame:
    """packet, words, id, piece: at each packet a row with the rows of ``encode_entries`` (words: part, sizes, ids), and one
    for each distinct id of the packet with the piece that it joins."""
    short = known.schema["ids"].dataType.elementType.typeName() == "short"
    words = known.repartition("packet").groupBy("packet").agg(F.collect_list(F.struct("part", "sizes", "ids")).alias("words"))
    kind = words.schema["words"].dataType
    number = (lambda i: i.cast("int").bitwiseAND(F.lit(0xFFFF))) if short else (lambda i: i)
    ids = F.transform(F.array_distinct(F.flatten("words.ids")), lambda i: F.struct(F.lit(None).cast(kind).alias("words"), number(i).alias("id")))
    whole = F.array(F.struct(F.col("words"), F.lit(None).cast("int").alias("id")))  # within the generated rows, so that it isn't repeated beside them
    return _with_pieces(words.select("packet", F.inline(F.concat(whole, ids))), path).select("packet", "words", "id", "piece")


def _with_pieces(ids: DataFrame, path: str) -> DataFrame:
    """Rows with an ``id`` and the bytes of its piece."""
    return ids.join(F.broadcast(pieces(ids.sparkSession, path)), "id", "left")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of each row of ``encoded`` (doc_id, ids array<int>), special tokens included."""
    path = tokenizer or tokenizer_path()
    small_batches(encoded.sparkSession)

    def single_ids(column):
        import pyarrow as pa
        import pyarrow.compute as pc

        column = pc.fill_null(column, [])
        flat, offsets = column.flatten(), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy()))
        keep = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        raw = flat.filter(pa.array(keep)).to_numpy().astype(">i4").tobytes()
        entries = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4), int(keep.sum()), [None, pa.py_buffer(raw)])
        return entries.cast(pa.binary()), np.append(0, np.cumsum(keep))[offsets[1:]]

    packets = _packets(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), single_ids, "bpe_given")
    given = _entries(packets).select("packet", F.posexplode("entries").alias("code", "entry")).select("packet", "code", F.conv(F.hex("entry"), 16, 10).cast("long").alias("id"))

    def rows(values, entries, codes, ends):
        import pyarrow.compute as pc

        values = values.combine_chunks()
        piece = pc.fill_null(values.column("piece").combine_chunks().cast("large_binary"), b"")
        at, data = _parts(piece)
        own = _in_code_order(values.column("code").to_numpy(), np.diff(at), np.frombuffer(data, np.uint8)[at[0] : at[-1]])
        return {"text": [str(r, "utf-8", "replace") for r in _laid_out(own, codes, ends)]}

    return _by_position(packets, _with_pieces(given, path).select("packet", "code", "piece"), "doc_id long, text string", rows)


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian u4) and decoded_sha256 (of the text that the pieces of the ids
    spell): both ways over one set of packets."""
    path = tokenizer or tokenizer_path()
    packets = split_words(docs, path)
    known, parts = encode_entries(_entries(packets), path)

    def rows(values, entries, codes, ends):
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = values.column("id").is_null()
        words = pc.list_flatten(values.filter(whole).column("words")).combine_chunks()
        order, sizes, ids = _by_code(pa.Table.from_arrays(words.flatten(), ["part", "sizes", "ids"]), entries, parts)
        own = values.filter(pc.invert(whole))
        piece = pc.fill_null(own.column("piece").combine_chunks().cast(pa.large_binary()), b"")
        place = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.int32)
        place[own.column("id").to_numpy()] = np.arange(len(own), dtype=np.int32)
        at, data = _parts(piece.take(pa.array(place[ids])))  # the pieces of all ids of the words
        spelled = np.diff(at[np.append(0, np.cumsum(sizes))])
        numbers = [(len(r) // 4, hashlib.sha256(r).hexdigest()) for r in _laid_out(_in_code_order(order, sizes, ids.astype("<u4")), codes, ends)]
        texts = [hashlib.sha256(str(r, "utf-8", "replace").encode()).hexdigest() for r in _laid_out(_in_code_order(order, spelled, np.frombuffer(data, np.uint8)), codes, ends)]
        return {"n_tokens": pa.array([x for x, _ in numbers], pa.int64()), "ids_sha256": pa.array([x for _, x in numbers], pa.string()), "decoded_sha256": pa.array(texts, pa.string())}

    return _by_position(packets, _with_own_pieces(known, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op13_word_table(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "documents"))


QUERIES = {"op13_word_table": op13_word_table}
