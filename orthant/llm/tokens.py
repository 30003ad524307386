"""Token ids in Arrow files of equal-length sequences.

Documents are ordered by id (range partitions, sorted), encoded, closed with an end id and laid end to
end. Each partition writes one shard: an Arrow IPC file (the stream format with a footer) whose
batches have two fixed-size-list columns, ``input_ids`` and ``mask`` (1 for ids, 0 for the padding of
the last sequence), so that sequence i of a memory-mapped file is a slice without a copy. A
second Arrow file beside it lists the shard's documents with their place in it.

Ids are stored in the least unsigned type that holds the vocabulary. A word's ids don't depend on
its neighbours in a tokenizer that drops white space, so ids of words that were seen are kept in a
cache of bounded bytes; new words are encoded by the tokenizers library.

Lost executors: a task writes under a name of its own attempt and moves the finished files to the
shard's name; the table of finished shards is written to the shared folder, too, and rereading
starts from that. Nothing is collected on the driver.

Cases: a null or empty text has the end id only; rows that repeat an id are written one after the
other, in order of a hash of the text; a null id comes first; no rows give no shard; further columns are never
looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import map_arrow, materialize, plain_columns, shared_dir, text_hash

END_ID, SEQUENCE, SEQUENCES_A_BATCH = 2, 1024, 64
CACHED_WORDS, CACHED_CHARS = 400_000, 64
# Fixed value: the pattern of the pieces of the word tokenizers that are encoded by words.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters beside ASCII that stay as they are under NFC and have one lower-case letter: Latin (but the dotted I) and Cyrillic.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u045f]+")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHARD = "shard long, n_docs long, n_tokens long"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system that driver and executors share, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + (rest if rest.startswith("//") else f"//{rest}"))


def _byte_level() -> dict[int, str]:
    """What the byte-level step writes for each letter beyond ASCII: a letter for each byte of its UTF-8. Bytes that
    are printable in Latin-1 stand for themselves, the others are numbered from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x80, 0x800)}


BYTE_LEVEL = _byte_level()


class WordIds(dict):
    """Ids of words as bytes; a word that isn't there is found in the generation before or encoded.
    Words longer than ``CACHED_CHARS`` are encoded each time, so the cache's bytes are bounded."""

    def __init__(self, encode: Callable[[str], bytes], before: dict[str, bytes]):
        super().__init__({"": b""})
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(word) > CACHED_CHARS:
            return self.encode(word)
        ids = self.before.get(word)
        if ids is None:
            ids = self.encode(word)
        self[word] = ids
        return ids


class Encoder:
    """Ids of texts as bytes of ``dtype``.

    What a tokenizer declares decides how it is used. If it normalises by NFC, runs of white space to
    one space and lower case, and keeps the matches of a pattern (none of which holds white space), then
    nothing reaches over a space and words are encoded one by one. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size()
        self.dtype, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        declared = json.loads(self.tokenizer.to_str())
        self.pattern = self._pieces(declared)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in declared["added_tokens"]) or r"(?!)")
        self.by_word = self.pattern is not None and not any(regex.search(r"\s", t["content"]) or t["content"].isalpha() or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in declared["added_tokens"])
        self.known = WordIds(self._word, {})

    @staticmethod
    def _pieces(declared: dict) -> regex.Pattern | None:
        """The pattern of a tokenizer that declares the steps above."""
        before, cut, model = declared["normalizer"] or {}, declared["pre_tokenizer"] or {}, declared["model"]
        if declared["post_processor"] or declared["truncation"] or model.get("dropout") or model.get("continuing_subword_prefix") or model["type"] != "BPE":
            return None
        if before.get("normalizers") != [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]:
            return None
        steps = cut.get("pretokenizers", [])
        if [x["type"] for x in steps] != ["Split", "ByteLevel"] or steps[0]["pattern"].get("Regex") != PIECE or steps[0]["behavior"] != "Removed" or not steps[0]["invert"] or steps[1]["add_prefix_space"] or steps[1]["use_regex"]:
            return None
        return regex.compile(PIECE)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _bytes(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._bytes([t.id for t in self.model.tokenize(piece)])

    def _word(self, word: str) -> bytes:
        """Words of PLAIN characters go piece by piece through the model, since lower case is all that
        normalising does to them; others, and those with a special token (which is sought
        before the case is lowered, and isn't all letters), through the whole tokenizer."""
        if word.isalpha():
            if word.isascii():
                return self._piece(word.lower())
            return self._piece(word.lower().translate(BYTE_LEVEL)) if PLAIN.fullmatch(word) else self._bytes(self._ids(word))
        if not PLAIN.fullmatch(word) or self.special.search(word):
            return self._bytes(self._ids(word))
        stem = word.rstrip(SIGNS)
        if stem.isalpha():  # signs behind letters are one piece
            return self.known[stem] + self.known[word[len(stem) :]]
        pieces = self.pattern.findall(word.lower())
        return b"".join([self.known[p] for p in pieces]) if len(pieces) > 1 else self._piece(pieces[0].translate(BYTE_LEVEL))

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._bytes(self._ids(text))
        if len(self.known) > CACHED_WORDS:  # words of the generation before are kept if they come again
            self.known.before = {}
            self.known = WordIds(self._word, self.known)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, whatever the number of its tasks."""
    return Encoder(path)


class ShardWriter:
    def __init__(self, file_system: fs.FileSystem, path: str, dtype: np.dtype, length: int):
        self.length, self.dtype, self.kind = length, dtype, pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("input_ids", pa.list_(self.kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = file_system.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.parts: list[bytes] = []
        self.held = self.written = 0

    def add(self, ids: bytes) -> int:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.length * SEQUENCES_A_BATCH * self.dtype.itemsize:
            self._flush(False)
        return len(ids) // self.dtype.itemsize

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), self.dtype)
        step = self.length * (1 if last else SEQUENCES_A_BATCH)
        n = len(ids) if last else len(ids) // step * step
        for s in range(0, n, self.length * SEQUENCES_A_BATCH):
            part = ids[s : min(n, s + self.length * SEQUENCES_A_BATCH)]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            mask[len(part) :] = False
            values = [pa.array(np.pad(part, (0, pad)), self.kind), pa.array(mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(v, self.length) for v in values], schema=self.schema))
        self.parts = [ids[n:].tobytes()]
        self.held = len(self.parts[0])

    def close(self) -> None:
        self._flush(True)
        self.out.close()
        self.sink.close()


class Shard:
    """Random access to the sequences of one shard; local files are memory-mapped."""

    def __init__(self, folder: str, shard: int):
        self.fs, self.root = open_folder(folder)
        name = f"{self.root}/shard-{shard:07d}"
        local = isinstance(self.fs, fs.LocalFileSystem)
        self.source = pa.memory_map(f"{name}.arrow") if local else self.fs.open_input_file(f"{name}.arrow")
        self.file = pa.ipc.open_file(self.source)
        self.docs = pa.ipc.open_file(self.fs.open_input_file(f"{name}.docs.arrow")).read_all()

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view of the file) and mask of sequence i."""
        batch = self.file.get_batch(i // SEQUENCES_A_BATCH)
        row = i % SEQUENCES_A_BATCH
        return batch.column(0)[row].values.to_numpy(zero_copy_only=True), batch.column(1)[row].values

    def digests(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, start in the shard, number of ids, crc32 of the ids as unsigned 32-bit) by
        reading all sequences in order."""
        starts, counts = (self.docs.column(k).to_numpy() for k in ("start", "n_tokens"))
        ids, d, at, crc = self.docs.column("doc_id").to_pylist(), 0, 0, 0
        for b in range(self.file.num_record_batches):
            values = self.file.get_batch(b).column(0).flatten().to_numpy(zero_copy_only=True).astype("<u4")
            upto = at + len(values)
            while d < len(ids) and starts[d] < upto:
                end = starts[d] + counts[d]
                crc = zlib.crc32(values[max(starts[d], at) - at : min(end, upto) - at].tobytes(), crc)
                if end > upto:
                    break
                yield ids[d], int(starts[d]), int(counts[d]), crc
                d, crc = d + 1, 0
            at = upto


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all documents; gives the table of shards (shard, n_docs, n_tokens) and the folder."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        file_system, root = open_folder(f"{folder}/tokens")
        file_system.create_dir(root, recursive=True)
        own = encoder(tokenizer)
        close = np.array([end_id], own.dtype).tobytes()
        final, mine = f"{root}/shard-{context.partitionId():07d}", f"{root}/attempt-{context.taskAttemptId()}"
        writer, ids, counts = None, [], []
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ShardWriter(file_system, f"{mine}.arrow", own.dtype, length)
            for text in batch.column(1).to_pylist():
                counts.append(writer.add((own.encode(text) if text else b"") + close))
            ids.append(batch.column(0))
        if writer is None:
            return
        writer.close()
        n = np.array(counts, np.int64)
        table = pa.table({"doc_id": pa.chunked_array(ids, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
        with file_system.open_output_stream(f"{mine}.docs.arrow") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        for end in (".docs.arrow", ".arrow"):
            if file_system.get_file_info(final + end).type != fs.FileType.NotFound:
                file_system.delete_file(final + end)
            file_system.move(mine + end, final + end)
        yield pa.RecordBatch.from_pydict({"shard": [context.partitionId()], "n_docs": [len(n)], "n_tokens": [int(n.sum())]})

    # Ties of an id are ordered by their texts' hashes, so that an id of many rows is many partitions.
    rows = plain_columns(docs, doc_id=id_col, text=text_col).withColumn("tie", text_hash(F.col("text")))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return materialize(map_arrow(ordered, run, SHARD), folder, "shards"), folder


def read_digests(shards: DataFrame, folder: str) -> DataFrame:
    """DIGEST of every document, from the files; start counts all shards before. The window runs
    over one row for each shard."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = list(Shard(f"{folder}/tokens", shard).digests())
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(np.array(columns[1]) + offset), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # A fixed number of partitions: rows are few bytes here, and whole files to read.
    return map_arrow(placed.repartition(max(1, shards.count()), "shard"), run, DIGEST)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the documents' ids and read them back as DIGEST."""
    return read_digests(*write_tokens(docs, tokenizer, end_id, length, id_col, text_col))
