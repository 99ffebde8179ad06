"""Operator 8: token ids in fixed-width bit packing.

A store is a Parquet folder with a row per block: file_no, block_no, start_in_file (ids of the file before the block),
n_docs, n_ids and ``payload``. A payload is

    magic "FTK1" | width u1 | 3 bytes 0 | n_docs u4 | n_ids u8 | doc_id i8 * n_docs | is_null u1 * n_docs, padded to 8
    | offset u8 * (n_docs + 1) | ids, ``width`` bits each, lowest bit first, padded by 8 bytes

little-endian throughout. ``width`` is the least number of bits that holds every id of the vocabulary, so the id at
place k stands at bit k * width: any range unpacks with one vectorised read. Documents lie whole in a block, in
ascending doc_id (null first), blocks in order in a file, files in order in the store.

Texts are encoded as the tokenizer file says, its added tokens in a text included.

Edge cases: null and empty texts hold only the end id; rows with the same doc_id lie side by side, ordered by a hash
of the text; an empty table gives an empty store; other columns are not stored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feira.llm.common import shared_folder, small_batches, table

MAGIC = b"FTK1"
BLOCK_IDS = 65_536
STORE = "file_no int, block_no int, start_in_file long, n_docs int, n_ids long, payload binary"

#: Remembered pieces of text of a kind in a Python worker; beyond, it begins anew.
CACHE = 900_000
#: Pieces given to the tokenizer as one text.
LEARNT_AT_ONCE = 64
#: Bytes of text whose words are numbered together.
TEXT_BYTES = 12 << 20
#: Marks that are parted from the word before them (no apostrophes: those begin contractions).
MARKS = ",.;:!?*#%&$"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes() + bytes(8)
    bits = (ids.astype(np.uint32)[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + bytes(8)


def unpack(packed: memoryview, width: int, first: int, count: int) -> np.ndarray:
    """``count`` ids from place ``first`` on."""
    if width == 16:
        return np.frombuffer(packed, "<u2", count, 2 * first).astype(np.uint32)
    bit = np.arange(first, first + count, dtype=np.int64) * width
    words = np.ndarray((max(0, len(packed) - 7),), "<u8", packed, strides=(1,))  # the 8 bytes from each byte on
    return ((words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def block(doc_ids: list[int | None], ids: list[bytes], width: int) -> tuple[bytes, int]:
    """The payload of documents whose ids are given as little-endian u4 bytes; and how many ids it holds."""
    offsets = np.zeros(len(ids) + 1, "<u8")
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    head = MAGIC + struct.pack("<B3xIQ", width, len(ids), int(offsets[-1]))
    null = bytes(d is None for d in doc_ids)
    index = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null + bytes(-len(null) % 8) + offsets.tobytes()
    return head + index + pack(np.frombuffer(b"".join(ids), "<u4"), width), int(offsets[-1])


def open_block(payload: bytes) -> tuple[list[int | None], np.ndarray, memoryview, int]:
    """doc ids, offsets (one more than documents), the packed ids and their width."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of packed ids")
    width, n, _ = struct.unpack_from("<B3xIQ", payload, 4)
    at = 20
    ids = np.frombuffer(payload, "<i8", n, at).tolist()
    null = payload[at + 8 * n : at + 9 * n]
    at += 9 * n + -n % 8
    offsets = np.frombuffer(payload, "<u8", n + 1, at).astype(np.int64)
    return [None if z else d for d, z in zip(ids, null, strict=True)], offsets, memoryview(payload)[at + 8 * n + 8 :], width


def _gathered(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``which`` of ``flat``, parted at ``ends`` (from 0), one after another, and where each ends."""
    many = (ends[1:] - ends[:-1])[which]
    made = np.cumsum(many)
    return flat[np.repeat(ends[which] - made + many, many) + np.arange(int(made[-1]) if len(made) else 0)], made


class Encoder:
    """Ids of whole texts, an Arrow column at a time.

    The tokenizer's own pattern (byte level) always parts a text between a non-space and a single space or line feed, so
    the pieces there are encoded once and remembered. Texts with other white space or with an added token's string, and
    all texts of a tokenizer of another kind, are encoded whole.
    """

    #: White space other than single spaces and line feeds between words.
    OTHER_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|  |\n\n| \n|\n "

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.in_pieces = made.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        added = [re.escape(t["content"]) for t in made.get("added_tokens", ()) if t["content"]]
        self.whole_if = "|".join([self.OTHER_SPACE, *added])
        feed = self.encode(["\n"])[0] if self.in_pieces else b""
        self.in_pieces = len(feed) == 4
        self.line_feed = int.from_bytes(feed, "little")
        self.forget()

    def forget(self) -> None:
        """Begin anew: nothing is remembered but no text at all, a space and a line feed, at places 0, 1 and 2."""
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)  # of all remembered pieces, one after another
        self.known: tuple[dict[str, int], dict[str, int]] = ({"": 0}, {"": 1})  # pieces without and with a space before them
        self.marks = {"": 0}
        self.remember([np.frombuffer(x, "<u4") for x in [b"", *self.encode([" ", "\n"])]])

    def remember(self, pieces: list[np.ndarray]) -> None:
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in pieces])])
        self.ids = np.concatenate([self.ids, *pieces])

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str], spaced: int) -> None:
        """Encode ``pieces`` that aren't known: some in one text, parted by line feeds, which no piece holds."""
        between = "\n " if spaced else "\n"
        ids, sizes = [], []
        for k in range(0, len(pieces), 8192):
            part = pieces[k : k + 8192]
            texts = [between[1:] + between.join(part[j : j + LEARNT_AT_ONCE]) for j in range(0, len(part), LEARNT_AT_ONCE)]
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                own = np.array(e.ids, "<u4")
                feed = own == self.line_feed
                sizes.append(np.diff(np.flatnonzero(feed), prepend=-1, append=len(own)) - 1)
                ids.append(own[~feed])
        first = len(self.ends) - 1
        ends = np.cumsum(np.concatenate(sizes))
        if len(ends) != len(pieces):
            raise ValueError("pieces and their ids don't agree")
        self.ends, self.ids = np.concatenate([self.ends, self.ends[-1] + ends]), np.concatenate([self.ids, *ids])
        self.known[spaced].update(zip(pieces, range(first, first + len(pieces)), strict=True))

    def places(self, stems: list[str], spaced: int) -> np.ndarray:
        """Where the ids of each of the distinct ``stems`` are remembered."""
        known = self.known[spaced]
        at = np.fromiter((known.get(x, -1) for x in stems), np.int64, len(stems))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.ends) - 1, len(self.ends) - 1 + len(new))
            self.learn([stems[k] for k in new.tolist()], spaced)
        return at

    def joined(self, column) -> tuple[memoryview, np.ndarray]:
        """Ids (little-endian u4) of all texts of an Arrow column without nulls, one after another, and where each text ends.

        A letter and the marks after it are always parted, so a known word needs no new merge for another mark.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if sum(map(len, self.known)) > CACHE or len(self.ids) > 16 * CACHE:
            self.forget()
        lines = pc.split_pattern(column, "\n")
        words = pc.split_pattern(lines.flatten(), " ")
        text_at, line_at = np.asarray(lines.offsets), np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        pieces, code = coded.dictionary, coded.indices.to_numpy()
        n = len(pieces)
        del lines, words, coded
        firsts = line_at[:-1]
        begins = np.zeros(len(firsts), bool)  # of a text; other lines begin after a line feed
        begins[text_at[:-1]] = True

        stripped = pc.utf8_rtrim(pieces, MARKS)
        longer = np.flatnonzero((pc.binary_length(pieces).to_numpy() > pc.binary_length(stripped).to_numpy()))
        lettered = pc.match_substring_regex(stripped.take(pa.array(longer)), r"\p{L}$").to_numpy(zero_copy_only=False)
        longer = longer[lettered]
        marked = np.zeros(n, bool)
        marked[longer] = True
        stems = pc.if_else(pa.array(marked), stripped, pieces).dictionary_encode()
        tails = pc.replace_substring_regex(pieces.take(pa.array(longer)), rf"^.*[^{MARKS}]", "").dictionary_encode()
        for mark in tails.dictionary.to_pylist():
            if mark not in self.marks:
                self.marks[mark] = len(self.ends) - 1
                self.remember([np.frombuffer(self.encode([mark])[0], "<u4")])
        stem, tail = stems.indices.to_numpy(), np.zeros(n, np.int64)
        tail[longer] = np.array([self.marks[m] for m in tails.dictionary.to_pylist()], np.int64)[tails.indices.to_numpy()]

        leads = code[firsts]  # pieces at the start of a line are encoded without a space
        lead_pieces, lead = np.unique(leads, return_inverse=True)
        lead_stems, lead_stem = np.unique(stem[lead_pieces], return_inverse=True)
        inner = np.ones(len(code), bool)
        inner[firsts] = False
        used = np.zeros(n, bool)
        used[code[inner]] = True
        spaced = np.flatnonzero(used)
        spaced_stems, spaced_stem = np.unique(stem[spaced], return_inverse=True)
        rows = np.zeros((len(spaced) + 2 * len(lead_pieces), 3), np.int64)  # each piece: a line feed, a stem and its marks
        a, b = len(spaced), len(spaced) + len(lead_pieces)
        rows[:a, 1] = self.places(stems.dictionary.take(pa.array(spaced_stems)).to_numpy(zero_copy_only=False).tolist(), 1)[spaced_stem]
        rows[:a, 2] = tail[spaced]
        lead_place = self.places(stems.dictionary.take(pa.array(lead_stems)).to_numpy(zero_copy_only=False).tolist(), 0)[lead_stem]
        for x, y in ((a, b), (b, len(rows))):  # leads twice, without and with a line feed before them
            rows[x:y, 1], rows[x:y, 2] = lead_place, tail[lead_pieces]
        rows[b:, 0] = 2
        flat, ends = _gathered(self.ids, self.ends, rows.ravel())

        place = np.zeros(n, np.int32)
        place[spaced] = np.arange(len(spaced))
        which = place[code]
        which[firsts] = np.where(begins, a, b) + lead
        offsets = 4 * np.append(0, ends[2::3])
        found = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).take(pa.array(which))
        ends = np.frombuffer(found.buffers()[1], "<i8", len(found) + 1) // 4
        return memoryview(found.buffers()[2] or b""), ends[line_at[text_at[1:]]]

    def __call__(self, column) -> list[bytes]:
        """Little-endian u4 ids of each text of an Arrow string column; null is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        column = column.cast(pa.large_string()).fill_null("")
        out: list[bytes] = [b""] * len(column)
        odd = pc.match_substring_regex(column, self.whole_if).to_numpy(zero_copy_only=False) if self.in_pieces else np.ones(len(column), bool)
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.encode([column[k].as_py()])[0]
        rest = np.flatnonzero(~odd)
        sizes = pc.binary_length(column).to_numpy()[rest]
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // TEXT_BYTES)) + 1 if len(rest) else []
        for mine in np.split(rest, cut) if len(rest) else ():
            (raw, ends), begin = self.joined(column.take(pa.array(mine))), 0
            for k, end in zip(mine.tolist(), ends.tolist(), strict=True):
                out[k] = bytes(raw[4 * begin : 4 * end])
                begin = end
        return out


def _larger(batches):
    """Batches joined to about TEXT_BYTES, so that fewer of their words repeat from one to the next."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= TEXT_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_ENCODERS: dict[str, Encoder] = {}


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> str:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each and write them in ascending doc_id; the store's folder.

    tokenizer: path of the file for the tokenizers library. Texts are dealt out once, by range of doc_id.
    """
    from tokenizers import Tokenizer

    path = tokenizer or tokenizer_path()
    width = width_of(Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True))
    end = np.array([end_id], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = _ENCODERS.setdefault(path, None) or _ENCODERS.update({path: Encoder(path)}) or _ENCODERS[path]
        file_no, number, start = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        held = 0

        def flush():
            nonlocal number, start, held
            payload, n = block(names, ids, width)
            row = pa.RecordBatch.from_pydict(
                {"file_no": [file_no], "block_no": [number], "start_in_file": [start], "n_docs": [len(ids)], "n_ids": [n], "payload": [payload]},
                schema=pa.schema([("file_no", pa.int32()), ("block_no", pa.int32()), ("start_in_file", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("payload", pa.binary())]),
            )
            number, start, held = number + 1, start + n, 0
            ids.clear()
            names.clear()
            return row

        for batch in _larger(batches):
            for name, own in zip(batch.column("doc_id").to_pylist(), encoder(batch.column("text")), strict=True):
                names.append(name)
                ids.append(own + end)
                held += len(ids[-1]) // 4
                if held >= block_ids:
                    yield flush()
            pa.default_memory_pool().release_unused()
        if ids:
            yield flush()

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    dealt = order.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    dealt.mapInArrow(write, STORE).write.parquet(folder)
    return folder


def _file_starts(blocks: DataFrame) -> DataFrame:
    """file_no, base: ids of all files before. One row for each file."""
    files = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("ids"))
    before = Window.partitionBy(F.lit(0)).orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("file_no", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))


def read_store(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens (with the end id) and ``ids`` array<int>, read from the
    files; with ``digest``, ids_crc32 (of the ids as little-endian u4) in place of ids."""
    blocks = spark.read.schema(STORE).parquet(folder)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for file_no, start, payload in zip(*(batch.column(c).to_pylist() for c in ("file_no", "start_in_file", "payload")), strict=True):
                names, at, packed, width = open_block(payload)
                ids = unpack(packed, width, 0, int(at[-1]))
                if digest:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    last = ("ids_crc32", pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()))
                else:
                    last = ("ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                columns = {"doc_id": pa.array(names, pa.int64()), "file_no": pa.array([file_no] * len(names), pa.int32()), "start": pa.array(at[:-1] + start, pa.int64()), "n_tokens": pa.array(np.diff(at), pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | dict([last]))

    kind = "ids_crc32 long" if digest else "ids array<int>"
    rows = blocks.select("file_no", "start_in_file", "payload").mapInArrow(read, f"doc_id long, file_no int, start long, n_tokens long, {kind}")
    rows = rows.join(_file_starts(blocks), "file_no").withColumn("start", F.col("start") + F.col("base"))
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids")


def token_range(spark: SparkSession, folder: str, start: int, count: int) -> DataFrame:
    """The ids at places ``start`` to ``start + count`` of the whole store as rows (start, ids): only the blocks that
    hold them are read, and of those only the range is unpacked."""
    blocks = spark.read.schema(STORE).parquet(folder)
    first = F.col("base") + F.col("start_in_file")
    near = blocks.join(_file_starts(blocks), "file_no").select(first.alias("first"), "n_ids", "payload")
    near = near.filter((F.col("first") < start + count) & (F.col("first") + F.col("n_ids") > start))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for at, n, payload in zip(*(batch.column(c).to_pylist() for c in ("first", "n_ids", "payload")), strict=True):
                a, b = max(start, at), min(start + count, at + n)
                ids = unpack(*open_block(payload)[2:], a - at, b - a)
                yield pa.RecordBatch.from_pydict({"start": pa.array([a], pa.int64()), "ids": pa.array([ids.astype(np.int32).tolist()], pa.list_(pa.int32()))})

    return near.mapInArrow(read, "start long, ids array<int>")


def token_digest(docs: DataFrame) -> DataFrame:
    """Write a store of ``docs`` in the shared folder and return what its files hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = write_store(docs, f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    return read_store(spark, folder, digest=True)


def op8_token_store(spark, sf_dir):
    return token_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_store": op8_token_store}
