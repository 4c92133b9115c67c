"""Token ids as fixed-width bit-packed files.

File layout, little-endian: magic ``TMBP0001``, u32 bits, u32 ids per block,
u64 documents, u64 ids, u64 blocks; then i64 doc_id[documents],
u64 end[documents] (ids up to and with each document), u64
block_offset[blocks + 1] (bytes from the payload's start); then the payload.
Each id takes ``bits`` bits, least significant first; a block starts on a byte.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import groups, map_arrow
from tidemark.operators.ordered import range_bounds
from tidemark.session import materialise, remove, scope, scratch_path

MAGIC = b"TMBP0001"
HEAD = struct.Struct("<8sIIQQQ")
BLOCK_IDS = 4096
FILE_IDS = 1 << 22
#: Source bytes of a range of documents, and from where on an estimate says nothing.
RANGE_BYTES = 64 << 20
UNKNOWN_BYTES = 1 << 55
CACHE_WORDS = 200_000
CACHE_RUNS = 400_000


def bits_for(vocab: int) -> int:
    """Fewest bits that hold every id below ``vocab``."""
    return max(1, int(vocab - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to bytes; ids that need more than ``bits`` bits are an error."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if len(ids) and bits < 32 and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    octets = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(octets, bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes as u32."""
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK_IDS) -> bytes:
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = HEAD.pack(MAGIC, bits, block, len(doc_ids), len(ids), len(blocks))
    return b"".join([head, np.asarray(doc_ids, "<i8").tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class PackedFile:
    """Random access to one file through any seekable binary handle."""

    def __init__(self, handle):
        self.handle = handle
        magic, self.bits, self.block, self.n_docs, self.n_ids, self.n_blocks = HEAD.unpack(self._at(0, HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(self._at(at, 8 * self.n_docs), "<i8")
        at += 8 * self.n_docs
        self.ends = np.frombuffer(self._at(at, 8 * self.n_docs), "<u8").astype(np.int64)
        at += 8 * self.n_docs
        self.offsets = np.frombuffer(self._at(at, 8 * (self.n_blocks + 1)), "<u8").astype(np.int64)
        self.payload = at + 8 * (self.n_blocks + 1)

    def _at(self, at: int, n: int) -> bytes:
        self.handle.seek(at)
        return self.handle.read(n)

    def slice(self, low: int, high: int) -> np.ndarray:
        """Ids [low, high): only the blocks that hold them are read."""
        if high <= low:
            return np.zeros(0, "<u4")
        first, last = low // self.block, (high - 1) // self.block
        data = self._at(self.payload + int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        parts = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            cut = int(self.offsets[b] - self.offsets[first])
            parts.append(unpack(data[cut : cut + int(self.offsets[b + 1] - self.offsets[b])], n, self.bits))
        return np.concatenate(parts)[low - first * self.block : high - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        """Ids of the i-th document."""
        return self.slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self, step: int = 1 << 16) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) in file order, about ``step`` ids in memory at a time."""
        i = 0
        while i < self.n_docs:
            low = int(self.ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(self.ends, low + step, "right")))
            part = self.slice(low, int(self.ends[j - 1]))
            for k in range(i, j):
                start = (int(self.ends[k - 1]) if k else 0) - low
                yield int(self.doc_ids[k]), part[start : int(self.ends[k]) - low]
            i = j


def open_store(uri: str):
    """(pyarrow file system, path) of a shared folder's URI or plain path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


#: Letters that the tokenizer's normaliser only lowers, and signs that it
#: leaves alone and that never join with letters.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")
#: Texts of letters, blanks, newlines and single stops and commas.
PLAIN = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ \n]++|[.,](?![.,]))*+")
#: Texts of letters, digits, signs, blanks and newlines, no special token in
#: them; and what they are cut into once lowered.
SIGNED = re.compile(r"(?:[A-Za-zÀ-ÖØ-öø-ÿ \n!-&(-;=-@\[-`{-~]++|<(?!\|))*+")
RUN = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
JOINED_RUNS = 512


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in plain else next(rest) for b in range(256)}


class Words(dict):
    """Ids of words as bytes.  A lookup of a new word notes it as fresh; two
    generations bound the size."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old, self.fresh = limit, {}, []

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: str) -> bytes | None:
        found = self.old.get(word)
        if found is None:
            self.fresh.append(word)
        self[word] = found
        return found


class Encoder:
    """Ids of texts by a tokenizer file, through bounded caches.

    The tokenizer drops white space and never looks across it, so a text's
    ids are those of its blank- and newline-separated parts in order.  Parts
    of runs of letters and of signs go to the tokenizer's model as these
    runs, many in one call; each run's ids end with the one that closes a
    word.  Any other part goes through the whole tokenizer.  A text of
    nothing but such runs is cut into them at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.runs_only = Tokenizer(self.tokenizer.model)
        self.runs_only.pre_tokenizer = WhitespaceSplit()
        suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
        self.closes = np.zeros(self.vocab, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.closes[i] = bool(suffix) and piece.endswith(suffix)
        self.words, self.runs = Words(CACHE_WORDS), Words(CACHE_RUNS)
        self.alphabet = byte_alphabet()

    def _learn_runs(self, runs: list[str]) -> None:
        written = [r if r.isascii() else r.encode().decode("latin-1").translate(self.alphabet) for r in runs]
        lots = [" ".join(written[i : i + JOINED_RUNS]) for i in range(0, len(written), JOINED_RUNS)]
        ids = [np.array(e.ids, "<u4") for e in self.runs_only.encode_batch_fast(lots, add_special_tokens=False)]
        flat = np.concatenate(ids)
        ends = (np.flatnonzero(self.closes[flat]) + 1) * 4
        if len(ends) != len(runs):
            raise ValueError("the model does not close every run once")
        data = flat.tobytes()
        self.runs.update(zip(runs, (data[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)), strict=True))

    def _learn(self, fresh: list[str]) -> None:
        simple, odd, runs = [], [], self.runs
        note, look = simple.append, runs.__getitem__
        for w in fresh:
            if w.isalpha():
                if w.isascii() or LETTERS.fullmatch(w):
                    w2 = w.lower()
                    note((w, w2, ""))
                    look(w2)
                    continue
            elif m := SIMPLE.fullmatch(w):
                letters, signs = m[1].lower(), m[2]
                note((w, letters, signs))
                if letters:
                    look(letters)
                if signs:
                    look(signs)
                continue
            odd.append(w)
        self._fill()
        words = self.words
        words.update((w, (runs[a] if a else b"") + (runs[b] if b else b"")) for w, a, b in simple)
        if odd:
            found = self.tokenizer.encode_batch(odd, add_special_tokens=False)
            words.update((w, array("I", e.ids).tobytes()) for w, e in zip(odd, found, strict=True))

    def _fill(self) -> None:
        """Ids of the runs that lookups have noted."""
        if self.runs.fresh:
            self._learn_runs(self.runs.fresh)
            self.runs.fresh = []

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        self.words.turn()
        self.runs.turn()
        of_run, of_word = self.runs.__getitem__, self.words.__getitem__
        parts = []
        for t in texts:
            if PLAIN.fullmatch(t):
                parts.append((of_run, t.lower().replace(".", " . ").replace(",", " , ").split()))
            elif SIGNED.fullmatch(t):
                parts.append((of_run, RUN.findall(t.lower())))
            else:
                parts.append((of_word, t.replace("\n", " ").split(" ")))
        for look, p in parts:
            deque(map(look, p), 0)
        if self.words.fresh:
            self._learn(self.words.fresh)
            self.words.fresh = []
        self._fill()
        return [np.frombuffer(b"".join(map(look, p)), "<u4") for look, p in parts]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def range_count(docs: DataFrame) -> int:
    """Ranges of doc_id: as many as shuffle partitions, or one for each
    RANGE_BYTES of the source by Spark's estimate where that is more, so that
    a task's share does not grow with the input."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // RANGE_BYTES) if size < UNKNOWN_BYTES else least


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode (doc_id, text) and write id files under ``folder``.

    Returns the manifest: bucket, part, path, n_docs, n_ids, start (ids in
    all files before).  Documents lie in ascending doc_id order over the
    files; rows of one doc_id lie in the order of their ids' bytes, rows
    without doc_id first.  A null text is the end id alone.  Only range
    bounds of doc_id come to the driver.  Files have unique names and only
    those in the manifest count, so a repeated task leaves at most an orphan.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = range_count(docs)
    bounds = np.asarray(range_bounds(docs, "doc_id", parts), np.int64)

    def encode(batches):
        run = encoder(tokenizer)
        for batch in batches:
            keys = batch.column("doc_id")
            at = np.searchsorted(bounds, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            for low, texts in groups(batch.column("text").to_pylist()):
                ids = [np.append(x, np.uint32(end_id)).astype("<u4") for x in run(texts)]
                cut = slice(low, low + len(texts))
                yield pa.RecordBatch.from_arrays([pa.array(at[cut], pa.int64()), keys[cut], pa.array([x.tobytes() if run.vocab > 1 << 16 else x.astype("<u2").tobytes() for x in ids], pa.binary())], ["bucket", "doc_id", "ids"])

    def write(batches):
        vocab = encoder(tokenizer).vocab
        kind, bits = ("<u4" if vocab > 1 << 16 else "<u2"), bits_for(max(vocab, end_id + 1))
        held, size, bucket, part = [], 0, None, 0
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)

        def flush():
            keys = [k for k, _ in held]
            lengths = [len(x) for _, x in held]
            data = encode_file([-(1 << 63) if k is None else k for k in keys], lengths, np.concatenate([x for _, x in held]), bits)
            path = f"{base}/ids-{bucket:010d}-{part:06d}-{uuid.uuid4().hex}.tmbp"
            with store.open_output_stream(path) as out:
                out.write(data)
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "part": part, "path": path, "n_docs": len(held), "n_ids": size}], manifest)

        manifest = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            for b, k, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "ids")), strict=True):
                ids = np.frombuffer(raw, kind)
                if held and (b != bucket or size + len(ids) > file_ids):
                    yield flush()
                    part = part + 1 if b == bucket else 0
                    held, size = [], 0
                held.append((k, ids))
                size += len(ids)
                bucket = b
        if held:
            yield flush()

    encoded = map_arrow(docs, encode, "bucket bigint, doc_id bigint, ids binary")
    placed = encoded.repartition(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "ids")
    files = materialise(map_arrow(placed, write, "bucket bigint, part bigint, path string, n_docs bigint, n_ids bigint"), "manifest")
    # one row a file, summed per bucket first: at most ``parts`` rows in the last window
    sums = files.groupBy("bucket").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inside = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("_i", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(sums, "bucket").withColumn("start", F.col("_b") + F.col("_i")).drop("_b", "_i")


def read_ids(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def read(batches):
        store, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(path) as handle:
                    rows, at = [], start
                    for key, ids in PackedFile(handle).documents():
                        rows.append((None if key == -(1 << 63) else key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return map_arrow(spread, read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row: all ids are written to
    files, which are read back and deleted.

    A null or empty text is the end id alone; texts may be of any length.
    Repeated rows and rows that share a doc_id or have none stay apart, as
    ``write_ids`` orders them.  Other columns are not read."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "ids")
    with scope(spark) as keep:
        found = keep(read_ids(write_ids(docs, tokenizer, folder, end_id), folder), "read-ids")
        remove(spark, folder)
    return found
