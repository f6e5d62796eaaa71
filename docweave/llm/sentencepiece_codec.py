"""SentencePiece encoding and decoding on the tokenizers library.

The model file is read with a small protobuf reader; from its pieces, scores and
specifications a ``tokenizers`` pipeline is built: normaliser (character map,
extra white space), metaspace marker, unigram scores or merge ranks, and byte
fallback.  ``Codec`` encodes batches of whole texts on the library's threads and
decodes ids with a table of the pieces' bytes.

Two texts are special: null and empty ones have no ids and decode to ``""``.
"""

from __future__ import annotations

import functools
import json
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import batches_of, carried, small_batches, tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of text that are encoded together; a longer text is a batch of its own.
BATCH_CHARS = 1_000_000
#: Threads of the library in a worker process, unless its environment says otherwise.
THREADS = "2"
#: Chunks of text whose ids a worker remembers; the memory is emptied beyond it.
CACHE_CHUNKS = 300_000


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; varints as int, all else as bytes."""
    i, end = 0, len(raw)

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < end:
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            size = varint()
        yield number, raw[i : i + size]
        i += size


class ModelFile:
    """Pieces (text, score, type) and the fields of the two specifications that encoding needs."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unk_id = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        self.unk_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.char_map = norm.get(2, b"")
        self.dummy_prefix = bool(norm.get(3, 1))
        self.trim = bool(norm.get(4, 1))
        if not norm.get(5, 1) or trainer.get(24, 0):
            raise ValueError("models without escaped white space, or with the marker as a suffix, aren't supported")


def build_tokenizer(model: ModelFile):
    """The tokenizers pipeline of a model."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        # what can be joined: two pieces whose text together is a piece, best score first
        whole = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
        merges = [(-score, vocab[p[:k]], vocab[p[k:]], p[:k], p[k:]) for p, score in whole.items() for k in range(1, len(p)) if p[:k] in whole and p[k:] in whole]
        merges.sort()
        core = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind}")
    tokenizer = Tokenizer(core)
    steps = []
    if model.char_map:
        steps.append(normalizers.Precompiled(model.char_map))
    if model.trim:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if splits_at_mark(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    users = [p for p, _, kind in model.pieces if kind == USER]
    if users:
        tokenizer.add_tokens([AddedToken(p, normalized=False) for p in users])
    return tokenizer


def splits_at_mark(model: ModelFile) -> bool:
    """True if no piece has a marker behind another character: then nothing is ever joined across one."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


class Codec:
    """Encodes and decodes with a model file; ``parity`` compares with the sentencepiece library."""

    def __init__(self, path: str, threads: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)  # each core has a worker process of its own
        self.path = path
        with open(path, "rb") as f:
            self.model = ModelFile(f.read())
        self.tokenizer = build_tokenizer(self.model)
        #: Chunks can be encoded once and remembered if the text is used as it is.
        self.chunked = splits_at_mark(self.model) and not self.model.char_map and not self.model.trim and not any(k == USER for *_, k in self.model.pieces) and self.model.dummy_prefix and any(p == MARK for p, *_ in self.model.pieces)
        self.known: dict[str, bytes] = {}
        self.lone = np.array([i for i, (p, *_) in enumerate(self.model.pieces) if p == MARK][:1], "<u4").tobytes()
        raw = [self._bytes(i) for i in range(len(self.model.pieces))]
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self._reference = None
        self.unequal: set[str] = set()

    def _bytes(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return (self.model.unk_surface if kind == UNKNOWN else piece.replace(MARK, " ")).encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as uint32.

        Where the pipeline splits at markers, a text's chunks (blanks and the
        text behind them) are encoded once per worker, in threaded batches.
        """
        if not self.chunked:
            return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        # a first chunk carries the dummy prefix as others carry their blank
        ready = [self._chunks(x) for x in texts]
        new = list(set().union(*ready).difference(self.known, {""}))
        if len(self.known) + len(new) > CACHE_CHUNKS:
            self.known = {}
            new = list(set().union(*ready) - {""})
        if new:
            # chunks behind one another behave as by themselves, so that many are encoded as one text, an end mark between them
            plain = [x for x in new if x and not x[0] == " " and "\n" not in x]
            self._learn(plain, "\n")
            for x, e in zip(rest := [x for x in new if x not in self.known], self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else [], strict=True):
                self.known[x] = np.array(e.ids, "<u4").tobytes()
            self._compare(new)
        self.known[""] = self.lone  # a blank at the end of a text
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<u4") for words in ready]

    def _learn(self, chunks: list[str], mark: str) -> None:
        """Encode chunks that don't hold mark: joined as `` chunk mark`` they come apart at its id."""
        ids = self.tokenizer.encode(mark, add_special_tokens=False).ids[1:] or [0]
        fence = ids[-1]
        groups = [chunks[lo : lo + 1000] for lo in range(0, len(chunks), 1000)]
        texts = [f" {mark} ".join(g) for g in groups]
        some = (e for lo in range(0, len(texts), 32) for e in self.tokenizer.encode_batch_fast(texts[lo : lo + 32], add_special_tokens=False))
        for g, e in zip(groups, some, strict=True):
            got = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(got == fence)
            raw = got.tobytes()
            # before each mark stands the marker of its own chunk
            spans = list(zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts - 4).tolist(), len(raw)], strict=True))
            if len(spans) == len(g):
                self.known.update(zip(g, (raw[i:j] for i, j in spans), strict=True))

    def parity(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the ids are those of the sentencepiece library.

        Where nothing is ever joined across markers, both libraries' ids of a
        text are those of its chunks, so each chunk is compared when it is
        learnt, and a text is at parity if all its chunks are.
        """
        if not self.chunked:
            return [a.tolist() == b for a, b in zip(ids, self.reference(texts), strict=True)]
        if not self.unequal:
            return [True] * len(texts)
        return [self.unequal.isdisjoint(self._chunks(x)) for x in texts]

    def _chunks(self, text: str) -> list[str]:
        """A text's chunks: the words between blanks, each with the extra blanks before it."""
        words = text.replace(MARK, " ").split(" ") if text else []
        return self._runs(words) if "" in words else words

    def _compare(self, chunks: list[str]) -> None:
        for x, b in zip(chunks, self.reference(chunks), strict=True):
            if array("I", b).tobytes() != self.known[x]:
                self.unequal.add(x)

    def _runs(self, words: list[str]) -> list[str]:
        """Words of a text split at every blank, with the empty ones joined to the next: ``" "`` per extra blank."""
        out, blanks = [], 0
        for w in words[:-1]:
            if w:
                out.append(" " * blanks + w)
                blanks = 0
            else:
                blanks += 1
        out.append(" " * blanks + words[-1])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, as UTF-8; bytes that aren't valid stay as they are."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        raw = self.table[at].tobytes()
        return raw[1:] if self.model.dummy_prefix and raw[:1] == b" " else raw

    def reference(self, texts: list[str]) -> list[list[int]]:
        """The ids that the sentencepiece library gives."""
        if self._reference is None:
            import sentencepiece

            self._reference = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self._reference.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """A worker process keeps its codec, and what it remembers, from task to task."""
    return Codec(path)


def encode_documents(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, parity: bool = True) -> DataFrame:
    """The rows' ``keep`` columns, and ids array<int>, n_tokens, n_byte_ids, parity, round_trip.

    A null text counts as empty and has no ids; repeated rows all get theirs; a
    carried column named like a result's gets ``in_`` before its name.

    parity: the ids equal those of the sentencepiece library (null if not asked
    for); see ``Codec.parity``.  round_trip: decoding gives the text again.  No shuffle; a batch of
    texts at a time is held.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    made = "ids array<int>, n_tokens long, n_byte_ids long, parity boolean, round_trip boolean"
    results = [x.split()[0] for x in made.split(", ")]
    held = {c: f"k_{i}" for i, c in enumerate(keep)}
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in held.items()], F.coalesce(F.col(text), F.lit("")).alias("__text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in source.drop("__text").schema), made])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = codec_of(model_path)
        for batch in batches:
            is_byte = np.array([k == BYTE for *_, k in codec.model.pieces])
            texts = batch.column("__text").to_pylist()
            for part in batches_of(texts, BATCH_CHARS):
                some = texts[part]
                ids = codec.encode(some)
                same = codec.parity(some, ids) if parity else [None] * len(some)
                back = [codec.decode(a) == x.encode() for a, x in zip(ids, some, strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(a) for a in ids])])
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                arrays = [batch.column(i).slice(part.start, part.stop - part.start) for i in range(len(keep))]
                arrays += [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), pa.array([len(a) for a in ids], pa.int64()), pa.array([int(is_byte[a].sum()) for a in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*held.values(), *results])

    small_batches(docs.sparkSession)
    names = carried(keep, results)
    return source.mapInArrow(tidy(run), schema).select(*[F.col(k).alias(names[c]) for c, k in held.items()], *results)


def decode_ids(frame: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The frame with the text of its ids; invalid UTF-8 becomes the replacement character."""

    def decode(values: pd.Series) -> pd.Series:
        codec = codec_of(model_path)
        return pd.Series([codec.decode(np.asarray(x if x is not None else [], np.int64)).decode("utf-8", "replace") for x in values])

    return frame.withColumn(into, F.pandas_udf(decode, "string")(F.col(ids)))


def describe(path: str) -> str:
    """A model file's type and specification as JSON."""
    with open(path, "rb") as f:
        m = ModelFile(f.read())
    return json.dumps({"kind": {UNIGRAM: "unigram", BPE: "bpe"}[m.kind], "pieces": len(m.pieces), "byte_fallback": m.byte_fallback, "dummy_prefix": m.dummy_prefix, "trim": m.trim})
