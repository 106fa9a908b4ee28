"""Token-ID / binary output (operator 3).

Every document is encoded, its id array (little-endian, unsigned 32 bits) is compressed as a
zstandard frame of its own with one dictionary that all documents share, and frames are packed
into segments in ascending ``doc_id`` order. A segment is one row of the store's table:

====================  =====================================================================
``shard``, ``seq``    place of the segment; (shard, seq) order is document order
``first_token``       ids in the segments of this shard before this one
``dict_hash``         SHA-256 of the dictionary that its frames need
``low``, ``high``     least and greatest doc_id (null if all are), by which a look-up skips
``doc_ids``           little-endian int64 per document; null ids are flagged in ``null_ids``
``offsets``           little-endian uint64, n + 1 byte offsets into ``data``
``lengths``           little-endian uint64, ids per document
``data``              the frames, one after the other
====================  =====================================================================

So one document is read by seeking to ``data[offsets[i]:offsets[i + 1]]`` alone. The container is
Parquet because Spark writes and reads it on any store that the cluster shares. The dictionary lies
beside the segments in a file named by its hash, which Spark's readers pass over, so the path alone
is enough to :func:`open` a store.

Edge cases: null text counts as empty (only the end id is stored); null ids sort first; repeated
rows are stored repeatedly, in an order fixed by doc_id and text; an empty table gives no segment;
other columns are ignored.
"""

from __future__ import annotations

import builtins
import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, blocks, release, scratch, tasks, utf8

#: Id that ends each document.
END_ID = 2
#: The dictionary is trained on the id arrays of this many documents (fewest, by hash of doc_id), cut
#: into pieces; if there are more than DICT_PIECES of these, on those of least hash.
DICT_SAMPLE, DICT_PIECE, DICT_PIECES = 400, 32 << 10, 512
DICT_BYTES = 64 << 10
LEVEL = 1
#: A segment is closed when it holds this many raw bytes of ids.
SEGMENT_BYTES = 2 << 20
#: Words a worker remembers; beyond, it keeps those of at most SHORT bytes.
CACHE_WORDS, SHORT = 1_000_000, 7
#: Words whose ids are put in place at once.
GATHERED = 1 << 18

#: What the dictionary's file is called before its hash.
DICTIONARY = "_dictionary-"

SEGMENT = "shard int, seq int, first_token long, dict_hash string, low long, high long, doc_ids binary, null_ids binary, offsets binary, lengths binary, data binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Case and line feeds, in texts that allow for it.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))
#: ASCII marks but for apostrophes, which the splitter takes together with letters.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes of U+0300 and beyond, and U+0130, whose small letter is one followed by a combining mark.
_BEYOND = re.compile(rb"[\xcc-\xff]|\xc4\xb0")
#: What :class:`WordEncoder` relies on in a tokenizer's file. Fixed values.
_SPLITTER = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_EXPECTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": _SPLITTER}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextEncoder:
    """Whole texts through a tokenizer's file, whatever is in it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each UTF-8 text."""
        found = self.model.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]


class WordEncoder(TextEncoder):
    """The same ids, with each distinct word encoded once, and looked up once in each list of texts.

    For files that normalise by NFC, white space to blanks and small letters, then keep the runs of
    letters, single numbers, runs of marks and English endings as pieces, each encoded by itself:

    * No piece holds white space, and NFC composes nothing with a blank or line feed, so a text's
      ids are those of its parts between blanks and line feeds in a row. Special tokens hold
      neither, so each lies in one part.
    * Below U+0300 nothing composes, and A-Z fold to themselves in small: such texts are folded
      first, unless they may hold a special token, which is looked for in the raw text. Beyond,
      NFC comes before case (H with a macron below stays two characters, h becomes one), so those
      texts are not folded.
    * Without characters of U+0300 and beyond, or U+0130, a letter stays one letter. A part that is
      such letters and then marks other than apostrophes is split between them by the splitter, so
      its ids are those of the two.
    * Words of such letters alone are one piece each, so at most one of a word's ids ends a word.
      Many are encoded in one call, and if as many ids end words as there are words, these ids
      separate them. All other words are encoded one by one.
    """

    def __init__(self, path: str):
        super().__init__(path)
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        # for words of a-z alone, which the file's normaliser and splitter leave as they are
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = {}
        self.ends = np.zeros(self.model.get_vocab_size(), bool)
        self.ends[[i for t, i in self.model.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def suits(path: str) -> bool:
        with builtins.open(path, encoding="utf-8") as f:
            config = json.load(f)
        added = [t["content"] for t in config["added_tokens"]]
        own = all(t.startswith("<|") and not t.split()[1:] for t in added) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"])
        model = config["model"]
        return own and all(config[k] == v for k, v in _EXPECTED.items()) and config["post_processor"] is None and model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"]

    def _learn(self, words: list[bytes], plain: bool) -> None:
        small, other, rest = [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # of bytes: a-z
                small.append(w)
            elif (plain or not _BEYOND.search(w)) and w.decode().isalpha():
                other.append(w)
            else:
                rest.append(w)
        for model, own in ((self.plain, small), (self.model, other)):
            chunks = [own[i : i + 256] for i in range(0, len(own), 256)]
            for chunk, e in zip(chunks, model.encode_batch_fast([b" ".join(c).decode() for c in chunks], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                cut = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
                if len(cut) != len(chunk) or cut[-1] != 4 * len(ids):
                    rest += chunk
                    continue
                flat = ids.tobytes()
                self.known.update(zip(chunk, [flat[a:b] for a, b in zip([0, *cut], cut)]))
        self.known.update(zip(rest, super().encode(rest)))

    def _know(self, new: list[bytes], plain: bool) -> None:
        """Learn words; ``plain``: none holds what :meth:`encode` does not fold."""
        known, marked = self.known, {}
        for w in new:
            stem = w.rstrip(_MARKS)
            if len(stem) < len(w) and (plain or not _BEYOND.search(stem) and b"<|" not in w) and (stem[-1:].isalpha() or stem.decode()[-1:].isalpha()):
                marked[w] = (stem, w[len(stem) :])
        parts = {x for pair in marked.values() for x in pair}
        self._learn([w for w in parts.union(new).difference(marked) if w not in known], plain)
        for w, (stem, marks) in marked.items():
            known[w] = known[stem] + known[marks]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS:  # short words come back most
            self.known = {w: ids for w, ids in self.known.items() if len(w) <= SHORT}
        known = self.known
        whole = b" ".join([*texts, b""])  # each word, a text's last too, has a blank behind it
        if not whole:
            return []
        plain = b"<|" not in whole and b"\xc4\xb0" not in whole and int(np.frombuffer(whole, np.uint8).max()) < 0xCC
        if plain:
            whole = whole.translate(_FOLD)
        else:
            whole = b" ".join([*(t.replace(b"\n", b" ") if b"<|" in t or _BEYOND.search(t) else t.translate(_FOLD) for t in texts), b""])
        end = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32) + 1
        at = np.concatenate(([0], end))
        found = pa.Array.from_buffers(pa.large_binary(), len(end), [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
        _, to, data = found.dictionary.buffers()
        words = data[: int(np.frombuffer(to, np.int64, len(found.dictionary) + 1)[-1])].to_pybytes().split(b" ")[:-1]
        ids = list(map(known.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        if new:
            self._know([words[i] for i in new], plain)
            for i in new:
                ids[i] = known[words[i]]
        # each distinct word's ids once, then for each word of the texts
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first, word = np.cumsum(size) - size, found.indices.to_numpy()
        stop = np.cumsum(size[word])
        parts = []
        for i in range(0, len(word), GATHERED):
            w = word[i : i + GATHERED]
            many = size[w]
            to = np.cumsum(many)
            parts.append(flat[np.repeat(first[w] - to + many, many) + np.arange(to[-1])].tobytes())
        raw = b"".join(parts)
        cut = (4 * stop[np.searchsorted(end, np.cumsum([len(t) + 1 for t in texts]))]).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]


_ENCODERS: dict[str, TextEncoder] = {}
KEPT.append(_ENCODERS)


def encoder(path: str) -> TextEncoder:
    """One encoder for each worker process, which Spark uses for many tasks."""
    if path not in _ENCODERS:
        release()  # what earlier operators freed
        _ENCODERS[path] = (WordEncoder if WordEncoder.suits(path) else TextEncoder)(path)
    return _ENCODERS[path]


@dataclass(frozen=True)
class TokenStore:
    """A written store: its segments and the dictionary that lies beside them."""

    spark: SparkSession
    path: str
    dictionary: bytes
    dict_hash: str

    def segments(self) -> DataFrame:
        return self.spark.read.schema(SEGMENT).parquet(self.path)

    def read(self, ids: bool = True) -> DataFrame:
        """Documents read back: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (binary)."""
        return _read(self, ids)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """Ids of the documents of this doc_id, from their own frames alone, in the store's order."""
        at = self.segments().where((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("shard", "seq")
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(self.dictionary))
        out = []
        for row in at.toLocalIterator():
            offsets = np.frombuffer(row["offsets"], "<u8")
            mine = (np.frombuffer(row["doc_ids"], "<i8") == doc_id) & (np.frombuffer(row["null_ids"], np.uint8) == 0)
            out += [np.frombuffer(unzip.decompress(row["data"][offsets[i] : offsets[i + 1]]), "<u4") for i in np.flatnonzero(mine).tolist()]
        return out


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from serialised id arrays of a bounded, fixed sample."""
    key = F.xxhash64("doc_id")
    last = [r[0] for r in docs.select(key.alias("h")).orderBy("h").limit(DICT_SAMPLE).collect()][-1:]
    # rows that repeat a doc_id share its key: the limit holds for them too
    sample = docs.where(key <= last[0] if last else F.lit(False)).where("text is not null").limit(DICT_SAMPLE)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            whole = e.encode(b.column(0).cast("binary").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + DICT_PIECE] for x in whole for i in range(0, len(x), DICT_PIECE)], pa.binary())], ["ids"])

    pieces = sample.select("text").mapInArrow(encode, "ids binary").orderBy(F.xxhash64("ids"), "ids").limit(DICT_PIECES)
    arrays = [bytes(r[0]) for r in pieces.collect()]
    try:
        return zstandard.train_dictionary(DICT_BYTES, arrays).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: their own bytes serve as content
        return b"".join(arrays)[:DICT_BYTES] or bytes(range(8))


def write(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> TokenStore:
    """Encode ``docs`` (doc_id, text) into a new store below the shared folder (or at ``path``)."""
    spark = docs.sparkSession
    tokenizer = tokenizer or vocabulary()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    raw = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(raw).hexdigest()
    out = path or scratch(spark, "tokens")
    n = max(tasks(spark), 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        shared = zstandard.ZstdCompressionDict(raw)
        shared.precompute_compress(level=LEVEL)  # once for all frames
        e, zip_ = encoder(tokenizer), zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        seq = first = 0
        ids, nulls, lengths, frames, held = [], [], [], [], 0

        def segment() -> pa.RecordBatch:
            nonlocal seq, first, held
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
            there = [d for d, z in zip(ids, nulls) if not z]
            row = [shard, seq, first, digest, min(there, default=None), max(there, default=None), np.array(ids, "<i8").tobytes(), np.array(nulls, np.uint8).tobytes(), offsets.tobytes(), np.array(lengths, "<u8").tobytes(), b"".join(frames)]
            seq, first, held = seq + 1, first + sum(lengths), 0
            for x in (ids, nulls, lengths, frames):
                x.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["shard", "seq", "first_token", "dict_hash", "low", "high", "doc_ids", "null_ids", "offsets", "lengths", "data"])

        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            buf, offsets = utf8(b.column(1))
            at, docs_ = offsets.tolist(), b.column(0).to_pylist()
            for i, j in blocks(offsets, 1 << 20):
                for k, flat in enumerate(e.encode([buf[at[x] : at[x + 1]].tobytes() for x in range(i, j)]), i):
                    flat += end
                    ids.append(docs_[k] or 0)
                    nulls.append(docs_[k] is None)
                    lengths.append(len(flat) // 4)
                    frames.append(zip_.compress(flat))
                    held += len(flat)
                    if held >= SEGMENT_BYTES:
                        yield segment()
        if ids:
            yield segment()

    # rows that share a doc_id, or have none, are told apart by a hash, so that they spread
    ordered = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    ordered.mapInArrow(pack, SEGMENT).write.option("compression", "uncompressed").parquet(out)
    fs, folder = _folder(spark, out)
    stream = fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, DICTIONARY + digest), False)
    try:
        stream.write(raw)
    finally:
        stream.close()
    return open(spark, out)


def _folder(spark: SparkSession, path: str):
    """The file system that holds ``path``, and the path there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def open(spark: SparkSession, path: str) -> TokenStore:
    """The store that :func:`write` left at ``path``, with its dictionary read from there."""
    fs, folder = _folder(spark, path)
    found = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith(DICTIONARY)]
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} dictionaries, not one")
    digest = found[0].getName().removeprefix(DICTIONARY)
    stream = fs.open(found[0])
    try:
        raw = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the dictionary of {path} is not the one that its name says")
    return TokenStore(spark, path, raw, digest)


def _read(store: TokenStore, with_ids: bool) -> DataFrame:
    """Decompress each document's frame and number its first id."""
    # one small row per shard: how many ids come before it
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(np.frombuffer(x, "<u8").sum()) for x in b.column(1).to_pylist()], pa.int64())], ["shard", "n"])

    per_shard = store.segments().select("shard", "lengths").mapInArrow(totals, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n")).orderBy("shard").collect()
    base, before = {}, 0
    for shard, n in per_shard:
        base[shard] = before
        before += n
    raw, digest = store.dictionary, store.dict_hash

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # the store is written: its encoder is not needed any more
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        for b in batches:
            for row in b.to_pylist():
                if row["dict_hash"] != digest:
                    raise ValueError(f"segment needs dictionary {row['dict_hash']}")
                offsets, ids = np.frombuffer(row["offsets"], "<u8").tolist(), np.frombuffer(row["doc_ids"], "<i8").tolist()
                flats = [unzip.decompress(row["data"][s:e]) for s, e in zip(offsets, offsets[1:])]
                n = np.array([len(f) // 4 for f in flats], np.int64)
                start = base[row["shard"]] + row["first_token"] + np.concatenate(([0], np.cumsum(n)[:-1]))
                docs = [None if z else d for d, z in zip(ids, row["null_ids"])]
                out = [pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(n), pa.array([zlib.crc32(f) for f in flats], pa.int64())]
                if with_ids:
                    out.append(pa.array(flats, pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return store.segments().mapInArrow(unpack, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
