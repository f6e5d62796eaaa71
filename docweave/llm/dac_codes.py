"""Token ids in directly addressable codes (Brisaboa, Ladra and Navarro, 2013).

A segment holds the ids of consecutive documents.  Each id is split into chunks
of ``CHUNK_BITS``, lowest first; level k stores the k-th chunk of all ids that
have one, and a bitmap that says which of them go on.  A rank directory counts
the bitmap's ones before every ``BLOCK`` bits, so that the place of any id's
next chunk, and with it any id, is found without decoding its neighbours.

Layout of a segment, little endian: magic ``DAC1``, uint32 levels, uint64 ids,
uint32 documents; per document int64 doc_id and uint64 end offset; then per level
uint64 n, n chunk bytes, the bitmap (n bits, padded to whole blocks) and the
directory (uint32 per block).

Segments are written by Spark as rows of a binary column into the shared
folder: the commit protocol keeps lost tasks out and any Hadoop store will do.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import batches_of, materialize, small_batches, tidy

CHUNK_BITS = 8
BLOCK = 512
MAGIC = b"DAC1"
#: Words that a worker remembers with their ids; the memory is emptied beyond it.
CACHE_WORDS = 800_000
#: Characters of text that are encoded together.
BATCH_CHARS = 2_000_000
#: Ids after which a segment is closed; a longer document is a segment of its own.
SEGMENT_IDS = 1_000_000
SEGMENT_SCHEMA = "first_doc long, n_docs long, n_ids long, payload binary"


def encode_ids(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: documents, the end of each in ids, and the ids."""
    parts, left, levels = [], ids.astype(np.uint32), 0
    while True:
        goes_on = left >= (1 << CHUNK_BITS)
        blocks = -(-len(left) // BLOCK)
        bits = np.zeros(blocks * BLOCK, np.uint8)
        bits[: len(left)] = goes_on
        ones = bits.reshape(blocks, BLOCK).sum(axis=1, dtype=np.uint32) if blocks else np.zeros(0, np.uint32)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        parts += [struct.pack("<Q", len(left)), (left & 0xFF).astype(np.uint8).tobytes(), np.packbits(bits, bitorder="little").tobytes(), directory.tobytes()]
        levels += 1
        if not goes_on.any():
            break
        left = left[goes_on] >> CHUNK_BITS
    table = np.empty(len(doc_ids), dtype=[("doc", "<i8"), ("end", "<u8")])
    table["doc"], table["end"] = doc_ids, ends
    return b"".join([MAGIC, struct.pack("<IQI", levels, len(ids), len(doc_ids)), table.tobytes(), *parts])


class Segment:
    """Reads a segment: ``segment[i]`` is the i-th id, ``decode()`` all of them."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a segment")
        levels, self.n, docs = struct.unpack_from("<IQI", payload, 4)
        at = 20
        table = np.frombuffer(payload, dtype=[("doc", "<i8"), ("end", "<u8")], count=docs, offset=at)
        self.doc_ids, self.ends = table["doc"], table["end"].astype(np.int64)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            blocks, at = -(-n // BLOCK), at + 8
            chunks = np.frombuffer(payload, np.uint8, n, at)
            bitmap = np.frombuffer(payload, np.uint8, blocks * BLOCK // 8, at + n)
            directory = np.frombuffer(payload, "<u4", blocks, at + n + len(bitmap))
            at += n + len(bitmap) + 4 * blocks
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            inside = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")[: i - block * BLOCK]
            i = int(directory[block]) + int(inside.sum())
        return value

    def decode(self) -> np.ndarray:
        """All ids, from the last level to the first."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype("<u4")
            if len(values):
                here[np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)] |= values << CHUNK_BITS
            values = here
        return values


class WordEncoder(dict):
    """The ids of chunks between blanks, as bytes, for a tokenizer whose tokens never hold white space.

    A chunk is encoded once per worker and remembered; whatever else counts as
    white space stays inside it and is left to the tokenizer.  Words of Latin
    letters go straight to the merges, which take them as one piece: in lower
    case, and without a final stop or comma, which is a token of its own.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        #: Latin letters as the merges see them: their bytes as visible characters.
        self.visible = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x180)}
        self.marks = {c: self._ids(c) for c in ".,"}
        self.direct = self._is_direct()

    def _is_direct(self) -> bool:
        """Whether words may go straight to the merges, as the file's own pipeline gives the same ids for words that cover its letters."""
        letters = [c for c in map(chr, range(0x41, 0x180)) if c.isalpha() and c != "\u0130"]
        probes = [w for c in letters for w in (c, f"a{c}b", f"{c}e{c}")] + ["straße", "don", "Tokens", "ÉTÉ", "ﬁ", "abc" * 30]
        probes = [w + mark for w in probes for mark in ("", ".", ",")]
        return all((p := self._plain(w)) is None or self._merged(p[0]) + p[1] == self._ids(w) for w in probes)

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[chunk] = raw = self._learn(chunk)
        return raw

    def _learn(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        plain = self._plain(chunk) if self.direct else None
        if plain is None:
            return self._ids(chunk)
        low, mark = plain
        return self._merged(low) if low == chunk else self[low] + mark

    def _plain(self, chunk: str) -> tuple[str, bytes] | None:
        """A word of Latin letters in lower case, and the ids of the stop or comma behind it; None for any other chunk."""
        mark = self.marks.get(chunk[-1])
        word = chunk[:-1] if mark else chunk
        if not word.isalpha() or not (word.isascii() or (max(word) < "\u0180" and "\u0130" not in word)):
            return None
        return word.lower(), mark or b""

    def _merged(self, low: str) -> bytes:
        return array("I", [t.id for t in self.merges(low if low.isascii() else low.translate(self.visible))]).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32."""
        get = self.__getitem__
        return [b"".join(map(get, x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for x in texts]


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """A worker process keeps its encoder, and what it remembers, from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordEncoder(path)


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Encode whole texts and write segments in ascending doc_id order; the written table.

    A null text counts as empty and gives the end id alone; repeated doc_ids
    stay, each row with its own ids.  Rows without a doc_id come first, as -2^63.
    Texts are dealt by ranges of doc_id, so that files are in order throughout
    and no task holds more than a segment and one batch of texts.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranged = (rows.repartitionByRange(partitions, "doc_id", F.xxhash64("text")) if partitions else rows.repartitionByRange("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        encoder = encoder_of(tokenizer_path)
        held_docs: list[int] = []
        held: list[bytes] = []
        size = 0
        end = np.array([end_id], "<u4").tobytes()

        def close() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            ends = np.cumsum([len(x) // 4 for x in held])
            return pd.DataFrame({"first_doc": [held_docs[0]], "n_docs": [len(held)], "n_ids": [len(ids)], "payload": [encode_ids(np.array(held_docs, np.int64), ends, ids)]})

        for batch in batches:
            texts, names = batch["text"].tolist(), batch["doc_id"].tolist()
            for part in batches_of(texts, BATCH_CHARS):
                for d, raw in zip(names[part], encoder.encode(texts[part]), strict=True):
                    held_docs.append(d)
                    held.append(raw + end)
                    size += len(raw) // 4 + 1
                    if size >= segment_ids:
                        yield close()
                        held_docs, held, size = [], [], 0
        if held:
            yield close()

    small_batches(docs.sparkSession)
    return materialize(ranged.mapInPandas(tidy(run), SEGMENT_SCHEMA), "dac")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the written segments: doc_id, start, n_tokens, ids_crc32.

    The starts come from the segments' own counts: sums of ranges of segments,
    then sums within each range.
    """
    order = lambda *ranges: Window.partitionBy(*ranges).orderBy("first_doc", "last_doc", "seg").rowsBetween(Window.unboundedPreceding, -1)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for number, payload in zip(batch["seg"], batch["payload"], strict=True):
                seg = Segment(bytes(payload))
                raw = memoryview(seg.decode().tobytes())
                ends = seg.ends
                starts = np.concatenate([[0], ends[:-1]])
                yield pd.DataFrame({"seg": number, "first_doc": seg.doc_ids[0], "last_doc": seg.doc_ids[-1], "n_ids": seg.n, "doc_id": seg.doc_ids, "at": starts, "n_tokens": ends - starts, "ids_crc32": [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist())]})

    local = segments.select(F.monotonically_increasing_id().alias("seg"), "payload").mapInPandas(tidy(run), "seg long, first_doc long, last_doc long, n_ids long, doc_id long, at long, n_tokens long, ids_crc32 long")
    local = materialize(local, "dac-docs")
    firsts = local.where("at = 0").select("seg", "first_doc", "last_doc", "n_ids")
    firsts = firsts.repartitionByRange("first_doc", "last_doc", "seg").withColumn("range", F.spark_partition_id())
    firsts = materialize(firsts, "dac-segments")
    ranges = firsts.groupBy("range").agg(F.sum("n_ids").alias("n")).select(F.col("range").alias("r2"), F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = firsts.withColumn("inside", F.coalesce(F.sum("n_ids").over(order("range")), F.lit(0)))
    base = within.join(ranges, F.col("range") == F.col("r2")).select("seg", (F.col("before") + F.col("inside")).alias("base"))
    return local.join(base, "seg").select(F.when(F.col("doc_id") > -(2**63), F.col("doc_id")).alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
