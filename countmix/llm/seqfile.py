"""Token-ID output: Arrow IPC files of equal-length sequences and masks.

The ids of all documents, in ascending id order and each followed by an end
id, are laid end to end and cut into sequences of ``seq_len``.  A shard is an
Arrow IPC file whose record batches hold

* ``ids``  fixed-size list of uint16 (uint32 for a vocabulary over 65,536),
* ``mask`` fixed-size list of bool, true where the position holds an id,
* ``doc_ids``, ``doc_starts``  lists: the documents that begin in a sequence
  and the position of each.

All sequences have one length, so sequence ``k`` of a memory-mapped shard is a
zero-copy slice (:func:`sequence`).  Only the last sequence of a shard is
padded.  A shard is written by one task as a stream in bounded memory; its name
carries a unique suffix, and the manifest names the shards of the attempts that
succeeded, so a task that runs twice leaves at most a file that nobody reads.

Edge cases: null text counts as empty and yields the end id alone; documents
with one id keep an order given by their text's hash; a null id sorts first;
an empty table has no shard.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_spec
from .common import scratch, texts

#: Sequences in a record batch.
BATCH_SEQUENCES = 256
#: Distinct pieces whose ids a worker remembers (about 200 bytes each).
CACHE_PIECES = 1_000_000


#: The first letter past Latin Extended-B.
LATIN = "\u0250"


def untouched(piece: str) -> bool:
    """True if composing and lower-casing surely leave the piece as it is."""
    return max(piece) < LATIN and piece == piece.lower() and unicodedata.is_normalized("NFC", piece)


class LibraryEncoder:
    """Whole texts (UTF-8) through the tokenizers library.  With ``by_piece`` each
    distinct piece between ASCII white space is encoded once: right for
    tokenizers that drop white space (their tokens never reach across it).  New
    pieces go to the library joined by a special token, which always splits."""

    def __init__(self, spec: str, by_piece: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 65_536 else np.dtype("<u4")
        j = json.loads(spec)
        special = [t for t in j["added_tokens"] if t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.special = [t["content"].lower().encode() for t in j["added_tokens"]]
        self.cut, self.cut_id = (special[0]["content"], special[0]["id"]) if special else (None, None)
        # texts that differ in ASCII case only are one to a lower-casing tokenizer
        norm = j["normalizer"] or {}
        self.lower = any(n["type"] == "Lowercase" for n in norm.get("normalizers", [norm] if norm else []))
        self.by_piece, self.pieces = by_piece and self.cut is not None, {}
        # what the normalizer leaves as it is can skip it: lower-case ASCII, and
        # lower-case composed Latin letters (below LATIN)
        steps = norm.get("normalizers", [norm] if norm else [])
        idle = all(n["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"}) for n in steps)
        self.plain = Tokenizer.from_str(json.dumps(j | {"normalizer": None, "truncation": None, "padding": None})) if idle and self.lower else None

    def _ids(self, batch: list[bytes]) -> list[bytes]:
        got = self.tok.encode_batch_fast([t.decode() for t in batch], add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in got]

    def _learn(self, new: list[bytes]) -> None:
        if self.plain is not None:
            idle = [p for p in new if p.isascii() or untouched(p.decode())]
            self._add(self.plain, idle)
            new = list(set(new).difference(idle))
        self._add(self.tok, new)

    def _add(self, tok, new: list[bytes]) -> None:
        lines = [new[i:i + 500] for i in range(0, len(new), 500)]
        got = tok.encode_batch_fast([self.cut.join([p.decode() for p in line]) for line in lines], add_special_tokens=False)
        for line, e in zip(lines, got, strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            at = np.flatnonzero(ids == self.cut_id)
            flat, size = ids.tobytes(), self.dtype.itemsize
            starts = [0, *((at + 1) * size).tolist()]
            ends = [*(at * size).tolist(), len(flat)]
            self.pieces.update(zip(line, map(flat.__getitem__, map(slice, starts, ends)), strict=True))

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """The little-endian ids of each text."""
        if not self.by_piece:
            return self._ids(batch)
        low = [t.lower() for t in batch]
        whole = [i for i, t in enumerate(low) if any(s in t for s in self.special)]
        cut = [t.split() for t in (low if self.lower else batch)]
        for i in whole:
            cut[i] = []
        words = set().union(*cut)
        new = words.difference(self.pieces)
        if len(self.pieces) + len(new) > CACHE_PIECES:
            # the pieces of this batch stay: the frequent ones are among them
            self.pieces = {w: self.pieces[w] for w in words.difference(new)}
        if new:
            self._learn(list(new))
        out = [b"".join(map(self.pieces.__getitem__, ws)) for ws in cut]
        if whole:
            for i, ids in zip(whole, self._ids([batch[i] for i in whole]), strict=True):
                out[i] = ids
        return out


_ENCODERS: dict[tuple, LibraryEncoder] = {}


def _encoder(spec: str, by_piece: bool) -> LibraryEncoder:
    key = (hashlib.sha1(spec.encode()).hexdigest(), by_piece)
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(spec, by_piece)
    return _ENCODERS[key]


def shard_schema(seq_len: int, dtype: np.dtype, id_type: pa.DataType) -> pa.Schema:
    return pa.schema([
        ("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)),
        ("mask", pa.list_(pa.bool_(), seq_len)),
        ("doc_ids", pa.list_(id_type)),
        ("doc_starts", pa.list_(pa.int32())),
    ])


class ShardWriter:
    """Writes documents one after another into one shard."""

    def __init__(self, stream, seq_len: int, dtype: np.dtype, id_type: pa.DataType):
        self.seq_len, self.dtype = seq_len, dtype
        self.schema = shard_schema(seq_len, dtype, id_type)
        self.out = pa.ipc.new_file(stream, self.schema)
        self.parts: list[bytes] = []
        self.n = self.n_docs = self.n_tokens = 0
        self.docs: list[tuple[object, int]] = []

    def add(self, doc_id, ids: bytes) -> None:
        self.docs.append((doc_id, self.n))
        self.parts.append(ids)
        size = len(ids) // self.dtype.itemsize
        self.n += size
        self.n_docs += 1
        self.n_tokens += size
        if self.n >= self.seq_len * BATCH_SEQUENCES:
            self._flush(self.n // self.seq_len)

    def _flush(self, n_seq: int) -> None:
        flat = np.frombuffer(b"".join(self.parts), dtype=self.dtype)
        size = n_seq * self.seq_len
        body, rest = flat[:size], flat[size:]
        mask = np.ones(size, dtype=bool)
        if len(body) < size:
            mask[len(body):] = False
            body = np.concatenate([body, np.zeros(size - len(body), dtype=self.dtype)])
        here = [d for d in self.docs if d[1] < size]
        seq = np.array([d[1] // self.seq_len for d in here], dtype=np.int64)
        offsets = pa.array(np.searchsorted(seq, np.arange(n_seq + 1)), pa.int32())
        self.out.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(body), self.seq_len),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.seq_len),
            pa.ListArray.from_arrays(offsets, pa.array([d[0] for d in here], self.schema.field("doc_ids").type.value_type)),
            pa.ListArray.from_arrays(offsets, pa.array([d[1] % self.seq_len for d in here], pa.int32())),
        ], schema=self.schema))
        self.docs = [(d, at - size) for d, at in self.docs if at >= size]
        self.parts, self.n = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n:
            self._flush(-(-self.n // self.seq_len))
        self.out.close()


def write_sequences(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, seq_len: int = 2048, end_id: int = 2, by_piece: bool = True, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode, pack and write; returns the manifest, one entry per shard
    (``shard, path, n_docs, n_tokens, start``), which also lies in ``out_dir``
    as ``manifest`` (Parquet).

    One shuffle: the texts are dealt by ranges of id and sorted within each,
    then encoded and written by the same task.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    rows = texts(docs, id_col, text_col)
    n = rows.rdd.getNumPartitions()
    tie = F.xxhash64("text").alias("tie")
    ordered = rows.select("doc_id", "text", tie).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", F.col("text").cast("binary").alias("text"))
    out_dir = out_dir or scratch(spark, "sequences")

    def run(batches):
        enc = _encoder(spec.value, by_piece)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        writer = None
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                ids = part.column("doc_id")
                if writer is None:
                    fs, path = pafs.FileSystem.from_uri(out_dir)
                    fs.create_dir(path)
                    shard = TaskContext.get().partitionId()
                    name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
                    stream = fs.open_output_stream(f"{path}/{name}")
                    writer = ShardWriter(stream, seq_len, enc.dtype, ids.type)
                for doc_id, code in zip(ids.to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    writer.add(doc_id, code + end)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{out_dir}/{name}"], "n_docs": [writer.n_docs], "n_tokens": [writer.n_tokens]})

    got = ordered.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long").collect()  # a row per shard
    manifest, start = [], 0
    for r in sorted(got, key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["n_tokens"]
    if manifest:
        spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.parquet(f"{out_dir}/manifest")
    return manifest


MANIFEST = "shard long, path string, n_docs long, n_tokens long, start long"


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    source = pa.memory_map(inner) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(inner)
    return pa.ipc.open_file(source)


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``k`` of a shard; the ids are a view of the
    mapped file."""
    reader = _open(path)
    batch = reader.get_batch(k // BATCH_SEQUENCES)
    at, n = k % BATCH_SEQUENCES, batch.schema.field("ids").type.list_size
    if at >= batch.num_rows:
        raise IndexError(f"the shard has no sequence {k}")
    ids = batch.column("ids").values.to_numpy(zero_copy_only=True)[at * n:(at + 1) * n]
    mask = batch.column("mask").values.slice(at * n, n).to_numpy(zero_copy_only=False)
    return ids, mask


def read_documents(path: str):
    """Of one shard, in order: ``(doc_id, ids)``; streams batch by batch."""
    reader = _open(path)
    doc, parts, open_doc = None, [], False
    for i in range(reader.num_record_batches):
        b = reader.get_batch(i)
        n = b.schema.field("ids").type.list_size
        ids = b.column("ids").values.to_numpy(zero_copy_only=True)
        valid = int(np.count_nonzero(b.column("mask").values.to_numpy(zero_copy_only=False)))
        per_seq = np.diff(b.column("doc_ids").offsets.to_numpy())
        starts = b.column("doc_starts").values.to_numpy() + np.repeat(np.arange(b.num_rows) * n, per_seq)
        at = 0
        for name, s in zip(b.column("doc_ids").values.to_pylist(), starts.tolist(), strict=True):
            if open_doc:
                yield doc, np.concatenate([*parts, ids[at:s]])
            doc, parts, at, open_doc = name, [], s, True
        parts.append(ids[at:valid])
    if open_doc:
        yield doc, np.concatenate(parts)


def read_digests(spark, manifest: list[dict], id_type: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, shard`` per document, read back from
    the shards, one task per shard; ``ids_crc32`` is over little-endian uint32."""
    if not manifest:
        return spark.createDataFrame([], f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard long")
    shards = spark.createDataFrame(manifest, MANIFEST).select("shard", "path", "start").repartition(len(manifest))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                out, at = [], r["start"]
                for doc_id, ids in read_documents(r["path"]):
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), r["shard"]))
                    at += len(ids)
                    if len(out) == 20_000:
                        yield _rows(out)
                        out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if k else pa.array(c) for k, c in enumerate(zip(*out, strict=True))], names)

    return shards.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard long")
