"""SentencePiece models run by the tokenizers library (dealt operator 1).

``read_model`` parses the model's protobuf; ``build`` makes a tokenizer of it:
normaliser (compiled character map, white-space rules, dummy prefix), the
metaspace marker, unigram scores or the merges that BPE scores imply, and byte
fallback.  ``Backend`` encodes batches with the library's threads.

A *unit* is a run of markers and what follows it up to the next marker.  No
piece goes on with a marker after another character (``build`` checks that), so
units are encoded alone and a worker keeps the answers in a bounded table.
New units are joined to long texts by a character that no longer piece has; the flat ids are split there again, so that no object is made a unit.
Parity: each new unit is also encoded by the SentencePiece library, and a row
says whether all its units agreed.

Null texts count as empty: no ids, parity true, decoded to the empty text.
Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import arrow_batches, process_cache

MARKER = "▁"
#: Piece types and the model type of the format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CACHE_UNITS, CACHED_CHARS = 500_000, 64
UNIT = re.compile(f"{MARKER}+[^{MARKER}]*|[^{MARKER}]+")
#: Stands between new units, and the characters of one joined text.
BETWEEN, JOINED_CHARS = "\x1e", 1 << 16


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protobuf message, in order."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[i:i + size]
            i += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)  # text, score, type
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    one_space: bool = True  # runs of white space become one, ends are stripped
    escape: bool = True


def read_model(data: bytes) -> Model:
    """The parts of a SentencePiece model that encoding depends on."""
    out = Model()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            out.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            out.kind, out.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rules = dict(fields(value))
            out.charsmap, out.dummy_prefix = rules.get(2, b""), bool(rules.get(3, 1))
            out.one_space, out.escape = bool(rules.get(4, 1)), bool(rules.get(5, 1))
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, the best score first."""
    usable = {p for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for rank, (piece, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            found += [(-score, rank, i, piece[:i], piece[i:]) for i in range(1, len(piece))
                      if piece[:i] in usable and piece[i:] in usable]
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: Model):
    """A ``tokenizers.Tokenizer`` with the model's normaliser, marker, pieces and decoder."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers
    unknown = next((i for i, (_, _, kind) in enumerate(model.pieces) if kind == UNKNOWN), None)
    if any(MARKER in p.lstrip(MARKER) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED)):
        raise ValueError("a piece goes on with a marker: texts cannot be cut at markers")
    if model.kind == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), fuse_unk=True,
                          unk_token=None if unknown is None else model.pieces[unknown][0], byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.one_space:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARKER))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    out.pre_tokenizer = pre_tokenizers.Split(Regex(UNIT.pattern), "isolated")
    end = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    own = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        out.add_tokens([AddedToken(p, normalized=True) for p in own])
    return out


class Backend:
    """Encodes and decodes whole texts; see the module's docstring."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece
        from tokenizers import decoders
        with open(path, "rb") as f:
            self.model = read_model(f.read())
        self.whole = build(self.model)
        self.units = build(self.model)
        self.units.normalizer = None
        self.units.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        # a unit with its marker is what the library makes of the unit's text
        self.by_unit = self.model.dummy_prefix and self.model.escape and not any(
            kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.split_id = self._separator()
        self.known: dict[str, tuple[bytes, bool, str]] = {}  # ids, parity, decoded

    def _separator(self) -> int | None:
        """The separator's id, if texts are not normalised and no longer piece holds the separator."""
        from tokenizers import Regex, pre_tokenizers
        if not (self.by_unit and not self.model.charsmap and not self.model.one_space):
            return None
        own = {BETWEEN: NORMAL, f"<0x{ord(BETWEEN):02X}>": BYTE}  # a piece, or else its byte
        number = {p: i for i, (p, _, kind) in enumerate(self.model.pieces) if own.get(p) == kind}
        if not number or any(BETWEEN in p and p != BETWEEN for p, _, _ in self.model.pieces):
            return None
        self.bulk = build(self.model)
        self.bulk.normalizer = None
        self.bulk.pre_tokenizer = pre_tokenizers.Split(
            Regex(f"{BETWEEN}|{MARKER}+[^{MARKER}{BETWEEN}]*|[^{MARKER}{BETWEEN}]+"), "isolated")
        found = number.get(BETWEEN, min(number.values()))
        one = self.bulk.encode(f"{MARKER}a{BETWEEN}{MARKER}", add_special_tokens=False).ids
        return found if one.count(found) == 1 else None

    def normalize(self, text: str) -> str:
        simple = self.by_unit and not self.model.charsmap and not self.model.one_space
        if simple:
            return MARKER + text.replace(" ", MARKER) if text else ""
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def _learn(self, units: set[str]) -> dict:
        """Ids, parity and decoded text by unit; the table starts afresh when it is full."""
        if len(self.known) > CACHE_UNITS:
            self.known = {}
        new = list(units.difference(self.known))
        if not new:
            return self.known
        # a lone marker (nothing is left of it without the prefix), units with the separator, very long ones, and
        # models without an id for it go one by one
        plain = [u for u in new if len(u) <= CACHED_CHARS and u[0] == MARKER != u and BETWEEN not in u] if self.split_id is not None else []
        found = self._joined(plain) if plain else {}
        rest = [u for u in new if u not in found] if len(plain) < len(new) else []
        if rest:
            mine = [e.ids for e in self.units.encode_batch_fast(rest, add_special_tokens=False)]
            agree = [True] * len(rest)  # unless compared here, whole texts are compared
            if self.by_unit:
                # the dummy prefix puts the first marker back; a lone marker is the prefix of a space
                theirs = self.reference.encode([u[1:].replace(MARKER, " ") for u in rest], num_threads=1)
                agree = [a == (b if u != MARKER else [self.reference.piece_to_id(MARKER)])
                         for u, a, b in zip(rest, mine, theirs)]
            shown = self.units.decode_batch(mine, skip_special_tokens=False)
            found.update((u, (np.array(i, "<u4").tobytes(), same, t)) for u, i, same, t in zip(rest, mine, agree, shown))
        long = {u for u in rest if len(u) > CACHED_CHARS}
        if not long:
            self.known.update(found)
            return self.known
        self.known.update((u, v) for u, v in found.items() if u not in long)
        return {u: self.known[u] if u in self.known else found[u] for u in units}

    def _joined(self, units: list[str]) -> dict[str, tuple[bytes, bool, str]]:
        """Ids, parity and decoded text by unit, of units that start with a marker and have no separator inside."""
        parts, part, size = [], [], 0
        for u in units:
            part.append(u)
            size += len(u) + 1
            if size >= JOINED_CHARS:
                parts.append(part)
                part, size = [], 0
        if part:
            parts.append(part)
        texts = [BETWEEN.join(p) for p in parts]
        out = {}
        encoded = self.bulk.encode_batch_fast(texts, add_special_tokens=False)
        for part, text, e in zip(parts, texts, encoded):
            ids = e.ids
            shown = self.units.decode(ids, skip_special_tokens=False).split(BETWEEN)
            mine, ends = self._split(ids)
            # the dummy prefix puts the first marker back
            theirs, there = self._split(self.reference.encode(text[1:].replace(MARKER, " ")))
            if len(ends) != len(part) or len(there) != len(part) or len(shown) != len(part):
                continue  # they are asked one by one
            data, begins = mine.tobytes(), np.concatenate([[0], ends[:-1] + 1])
            if len(mine) == len(theirs) and (mine == theirs).all():
                same = [True] * len(part)
            else:
                other, starts = theirs.tobytes(), np.concatenate([[0], there[:-1] + 1])
                same = [data[4 * a:4 * b] == other[4 * c:4 * d] for a, b, c, d in
                        zip(begins.tolist(), ends.tolist(), starts.tolist(), there.tolist())]
            out.update((u, (data[4 * a:4 * b], s, t)) for u, a, b, s, t in
                       zip(part, begins.tolist(), ends.tolist(), same, shown))
        return out

    def _split(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids as an array, and the places where a unit ends."""
        ids = np.array(ids, "<u4")
        return ids, np.concatenate([np.flatnonzero(ids == self.split_id), [len(ids)]])

    def run(self, texts: list[str]) -> list[tuple[np.ndarray, bool, str]]:
        """Ids of each text, whether the SentencePiece library gives the same, and the ids decoded."""
        cut = [UNIT.findall(self.normalize(t)) for t in texts]
        known, out = self._learn(set().union(*cut)), []
        for t, units in zip(texts, cut):
            found = [known[u] for u in units]
            ids = np.frombuffer(b"".join([f[0] for f in found]), "<u4")
            same = all([f[1] for f in found]) if self.by_unit else self.reference.encode(t) == ids.tolist()
            text = "".join([f[2] for f in found])
            out.append((ids, same, text[1:] if self.model.dummy_prefix else text))
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts, by the library's threads."""
        return [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(ids, skip_special_tokens=False)


def backend(path: str) -> Backend:
    cache, key = process_cache("sentencepiece"), ("sentencepiece", path)
    if key not in cache:
        cache[key] = Backend(path)
    return cache[key]


RESULT = "ids array<int>, parity boolean, decoded string"


def encode_decode(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids``, ``parity`` and the text ``decoded`` from the ids, without a shuffle."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        ids, same, decoded = [], [], []
        for i, s, d in backend(path).run(texts.to_pylist()):
            ids.append(i.astype(np.int32))
            same.append(s)
            decoded.append(d)
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_()),
                                           pa.array(decoded, pa.string())], ["ids", "parity", "decoded"])

    return docs.select(*keep, run(F.coalesce(F.col(text), F.lit(""))).alias("__r")).select(*keep, "__r.*")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: number of ids, their crc32 (little-endian unsigned 32-bit), parity, and whether decoding gives the text."""
    arrow_batches(docs.sparkSession)

    @F.arrow_udf("n_tokens long, ids_crc32 long, parity boolean, round_trip boolean")
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.to_pylist()
        found = backend(path).run(texts)
        columns = ([len(i) for i, _, _ in found], [zlib.crc32(i.tobytes()) for i, _, _ in found],
                   [s for _, s, _ in found], [d == t for t, (_, _, d) in zip(texts, found)])
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                          ["n_tokens", "ids_crc32", "parity", "round_trip"])

    return (docs.select(F.col(key).cast("long").alias("doc_id"), run(F.coalesce(F.col(text), F.lit(""))).alias("__r"))
            .select("doc_id", "__r.*"))
