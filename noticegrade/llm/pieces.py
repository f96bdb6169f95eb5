"""SentencePiece encoding and decoding on the tokenizers library.

The model file is a protocol buffer of pieces (text, score, kind), trainer settings and
normaliser settings. ``read_model`` reads its wire format; ``build_tokenizer`` rebuilds from it
what the file says: the normaliser (precompiled character map, white space, the leading mark),
the metaspace mark for spaces, the unigram scores or, for a BPE model, the merges that its
scores imply, and byte fallback. Whole texts are encoded in batches, on several threads.

Parity with the reference implementation is checked on every row whose hash is a multiple of
``parity_every``; decoding is checked on every row, by the pieces' own bytes.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from noticegrade.llm.words import slices, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
MARK = "▁"
#: Bytes of text that are encoded at a time.
BATCH_BYTES = 1 << 19

#: Fixed values of the model format: kinds of pieces, and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    treat_space_as_suffix: bool = False
    normaliser: str = ""
    character_map: bytes = b""
    add_leading_mark: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields in order; groups aren't part of the format."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"not a SentencePiece model: wire type {kind}")
        yield key >> 3, value


def read_model(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            score = struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            out.pieces.append((got.get(1, b"").decode(), score, got.get(3, NORMAL)))
        elif number == 2:
            got = dict(_fields(value))
            out.kind = got.get(3, UNIGRAM)
            out.treat_space_as_suffix = bool(got.get(24, 0))
            out.byte_fallback = bool(got.get(35, 0))
        elif number == 3:
            got = dict(_fields(value))
            out.normaliser, out.character_map = got.get(1, b"").decode(), got.get(2, b"")
            out.add_leading_mark = bool(got.get(3, 1))
            out.remove_extra_spaces = bool(got.get(4, 1))
            out.escape_spaces = bool(got.get(5, 1))
    if not out.pieces:
        raise ValueError("not a SentencePiece model: no pieces")
    if out.kind not in (UNIGRAM, BPE) or out.treat_space_as_suffix or not out.escape_spaces:
        raise ValueError("only unigram and BPE models with escaped, leading spaces are supported")
    return out


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """The pairs that BPE may merge, best first: by the score of what they make.

    Of the pairs that make one piece, the one with the shorter left part comes first; a text's
    merges don't depend on that, as both parts of a pair must have been made before.
    """
    usable = {p: (s, i) for i, (p, s, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, (score, i) in usable.items():
        found += [(-score, i, cut, piece[:cut], piece[cut:]) for cut in range(1, len(piece)) if piece[:cut] in usable and piece[cut:] in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: PieceModel) -> Tokenizer:
    """A tokenizer whose ids are those of the model file. Special pieces in a text are text."""
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        name = model.pieces[unknown][0] if unknown is not None else None
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model), unk_token=name, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.character_map)] if model.character_map else []
    if model.remove_extra_spaces:
        steps += [normalizers.Replace(Regex(" +"), " "), normalizers.Strip(left=True, right=True)]
    if model.add_leading_mark:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # If no piece goes on after a word's end, words can be taken one by one, which makes the search
    # for the best pieces shorter. Merges take a whole text in less time than its words.
    if model.kind == UNIGRAM and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_leading_mark:
        parts.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(parts)
    return tokenizer


@lru_cache(maxsize=2)
def _ready(data: bytes, threads: int) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    tokenizer = build_tokenizer(read_model(data))
    # texts come normalised, see marked(): the tokenizer would keep every character's origin as well
    tokenizer.normalizer = normalizers.Sequence([])
    return tokenizer


@lru_cache(maxsize=2)
def _model(data: bytes) -> PieceModel:
    return read_model(data)


@lru_cache(maxsize=2)
def _reference(data: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=data)


def encode(texts: list[str], data: bytes, threads: int = THREADS) -> list[list[int]]:
    """Ids of each text. An empty text has none."""
    tokenizer, out, model = _ready(data, threads), [[] for _ in texts], _model(data)
    full = {i: marked(t, model) for i, t in enumerate(texts) if t}
    for i, got in zip(full, tokenizer.encode_batch_fast(list(full.values()), add_special_tokens=False), strict=True):
        out[i] = got.ids
    return out


@lru_cache(maxsize=2)
def _spelled(data: bytes) -> tuple[list[bytes], bool]:
    """The bytes that each id stands for, and whether a leading mark is to be taken off."""
    model = read_model(data)
    spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
    return spelled, model.add_leading_mark


def decode(ids: list[list[int]], data: bytes) -> list[str]:
    """Texts of ids: their pieces' bytes read as UTF-8 (what isn't is replaced).

    The same as the tokenizer's own decoder, in a fraction of its time.
    """
    spelled, marked = _spelled(data)
    texts = (b"".join([spelled[i] for i in x]).decode("utf-8", "replace") for x in ids)
    return [t.removeprefix(" ") if marked else t for t in texts]


def marked(text: str, model: PieceModel) -> str:
    """What the rebuilt normaliser makes of a text: cleaned, with marks for spaces and at its start."""
    if model.character_map:
        text = normalizers.Precompiled(model.character_map).normalize_str(text)
    if model.remove_extra_spaces:
        text = " ".join(x for x in text.split(" ") if x).strip()
    if model.add_leading_mark and text:
        text = MARK + text
    return text.replace(" ", MARK)


def normalised(text: str, model: PieceModel) -> str:
    """What decoding gives back: the text as the normaliser leaves it."""
    if model.character_map:
        text = normalizers.Precompiled(model.character_map).normalize_str(text)
    text = " ".join(x for x in text.split(" ") if x) if model.remove_extra_spaces else text
    return text.replace(MARK, " ")  # a mark in a text is as good as a space


_ADDED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("ids_sha256", T.StringType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()),
    T.StructField("parity", T.BooleanType()),
])


def tokenise(
    docs: DataFrame, model_path: str = MODEL, keep: list[str] | None = None, add: list[str] | None = None,
    threads: int = THREADS, parity_every: int = 50,
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) with the tokens of the whole text.

    ``add`` picks from ids, ids_sha256 (of the ids as little-endian 32-bit numbers), n_tokens,
    round_trip (decoding the ids gives the text as normalised) and parity (the ids are those of
    the reference implementation; null on rows that aren't compared; ``parity_every`` = 1
    compares all, 0 none).

    Null and empty texts have no tokens. Columns of ``docs`` that have the name of an added one
    are replaced. The model file is read once, by the driver, and sent along.
    """
    add = add or _ADDED.names
    names = [c for c in keep or docs.columns if c not in add]
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    compare = F.pmod(F.xxhash64("text"), F.lit(parity_every)) == 0 if parity_every > 1 else F.lit(parity_every == 1)
    extra = [c for c in names if c != "text"]
    read = docs.select(*map(F.col, extra), F.col("text").cast("string").alias("text")).withColumn("compare ", compare)
    schema = T.StructType([read.schema[c] for c in names] + [_ADDED[c] for c in add])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = shared.value
        model = read_model(data)
        for whole in batches:
            for start, end in slices(text_buffers(whole.column("text"))[1], BATCH_BYTES):
                batch = whole.slice(start, end - start)
                columns = _columns(batch, data, model, threads, add)
                yield pa.RecordBatch.from_arrays([*map(batch.column, names), *columns], names=[*names, *add])

    return read.mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch, data: bytes, model: PieceModel, threads: int, add: list[str]) -> list[pa.Array]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    ids = encode(texts, data, threads)
    got: dict[str, pa.Array] = {"n_tokens": pa.array([len(x) for x in ids], pa.int64())}
    if "ids" in add:
        got["ids"] = pa.array(ids, pa.list_(pa.int32()))
    if "ids_sha256" in add:
        got["ids_sha256"] = pa.array([hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest() for x in ids])
    if "round_trip" in add:
        back = decode(ids, data)
        got["round_trip"] = pa.array([a == normalised(t, model) for a, t in zip(back, texts, strict=True)])
    if "parity" in add:
        rows = [i for i, yes in enumerate(batch.column("compare ").to_pylist()) if yes]
        theirs = _reference(data).encode([texts[i] for i in rows], num_threads=threads) if rows else []
        same: list[bool | None] = [None] * len(texts)
        for i, other in zip(rows, theirs, strict=True):
            same[i] = ids[i] == other
        got["parity"] = pa.array(same, pa.bool_())
    return [got[c] for c in add]
