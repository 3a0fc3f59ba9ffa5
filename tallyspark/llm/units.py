"""Byte-level BPE over whole texts inside Python workers.

A *unit* is a stretch of text between two safe boundaries: cutting there gives
the same ids as encoding the whole text at once.  The place before one ASCII
space with non-space characters on both sides is safe, because every
alternative of the byte-level pattern takes a space only as its first character
there; a line feed between two non-space characters is a unit of its own for
the same reason.  Special strings hold no white space, so no boundary falls
inside one.  A text without any safe boundary is one unit.

Natural text repeats its units.  Arrow cuts a batch of texts and numbers its
distinct units; the worker asks the library for each distinct one once and
keeps the answer in a bounded table.  A full table becomes the old one, from
which answers that are needed again are copied; the one before it is dropped.
Ids of whole texts are gathered with numpy.  Short units of characters whose
class every regex engine agrees on go through tiktoken with the file's own
vocabulary, which gives the same ids several times as fast; all other units, and
those with a special string, go through the tokenizers library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tallyspark.llm.common import process_cache

#: Units of a full table, the longest plain unit, UTF-8 bytes cut at once and per call of the library.
TABLE_UNITS, PLAIN_CHARS, CUT_BYTES, CALL_BYTES = 500_000, 64, 4 << 20, 1 << 20
#: Rows of an Arrow batch (its bytes are bounded as well): units that repeat within it are looked up once.
TOKEN_ROWS = 2048
#: Separator between units.
MARK = "\x01"
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Texts with this character or with white space other than single spaces and line feeds are cut at safe spaces only.
ODD_TEXT = "\x01|  |\n\n| \n|\n |[\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Letters and digits of plain units: ASCII, Latin, Cyrillic, Han, Hangul; and their other characters.
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u047f\u4e00-\u9fa5\uac00-\ud7a3"
DIGITS, OTHERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027"
PLAIN_UNIT = f"\\A(?:\n| ?[{LETTERS}{DIGITS}{OTHERS}]+)\\z"
#: A plain unit that is one match of the pattern.
PLAIN_WORD = f"\\A ?[{LETTERS}]+\\z"
WORD, MIXED, ODD = range(3)
#: The byte-level pattern of the tokenizer file (a fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The format's printable stand-in for each byte: itself, or the next free character from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


def byte_groups(texts: Iterable[str], limit: int = CALL_BYTES) -> Iterable[list[str]]:
    """Texts in order, in groups of about ``limit`` bytes (at least one text)."""
    group, size = [], 0
    for t in texts:
        n = len(t) if t.isascii() else len(t.encode())
        if group and size + n > limit:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def cut_units(texts: pa.Array) -> pa.Array:
    """The units of each text, as a list array; the units joined give the text."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, ODD_TEXT)
    clean, slow = texts.filter(pc.invert(odd)), texts.filter(odd).to_pylist()
    marked = pc.replace_substring(pc.replace_substring(clean, " ", MARK + " "), "\n", MARK + "\n" + MARK)
    lists = pc.split_pattern(marked, MARK)
    if not slow:
        return lists
    at, units = [], []
    for t in slow:
        ends = [m.start() for m in SAFE_SPACE.finditer(t)]
        at.append(len(units))
        units += [t[a:b] for a, b in zip([0, *ends], [*ends, len(t)])]
    lists = pa.concat_arrays([lists, pa.LargeListArray.from_arrays(pa.array([*at, len(units)], pa.int64()),
                                                                   pa.array(units, pa.large_string())).cast(lists.type)])
    mask = odd.to_numpy(zero_copy_only=False)
    return lists.take(pa.array(np.where(mask, len(clean) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)))


def objects(strings: pa.Array) -> list:
    """The strings (none null) as Python objects: ``to_pylist`` takes several times as long."""
    return strings.to_numpy(zero_copy_only=False).tolist()


def gather(begin: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """``ids[b:b + n]`` for each ``b, n``, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(ids)) < 1 << 31 else np.int64
    return ids[np.repeat((begin - (ends - size)).astype(kind), size) + np.arange(total, dtype=kind)]


class Table:
    """Ids of strings: a slot for each string, the begin and number of its ids, and all ids."""

    def __init__(self):
        self.slots: dict[str, int] = {}
        self.begins, self.sizes, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slots of distinct strings, and the places of new ones, whose ids ``put`` must give; one search a string."""
        first = len(self.begins)
        at = np.fromiter(map(self.slots.setdefault, strings, range(first, first + len(strings))), np.int64, len(strings))
        new = np.flatnonzero(at >= first)
        if len(new):
            room = np.zeros(int(at[new[-1]]) + 1 - first, np.int32)
            self.begins, self.sizes = np.concatenate([self.begins, room]), np.concatenate([self.sizes, room])
        return at, new

    def put(self, slots: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """The ids of new strings, one after another."""
        self.begins[slots] = len(self.ids) + np.cumsum(sizes) - sizes
        self.sizes[slots] = sizes
        self.ids = np.concatenate([self.ids, ids])

    def full(self, most: int) -> bool:
        return len(self.slots) > most or len(self.begins) > 4 * most or len(self.ids) > 16 * most


def rank_encoder(tokenizer):
    """The tiktoken library's encoder for plain units, if the tokenizer is a byte-level BPE model whose merges
    make their tokens in the order of the ids, so that ids alone say what to merge first; otherwise None."""
    import tiktoken
    stated = json.loads(tokenizer.to_str())
    model, cut = stated["model"], stated["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if (model["type"] != "BPE" or not plain or stated["normalizer"] or cut.get("type") != "ByteLevel"
            or cut.get("add_prefix_space") or not cut.get("use_regex", True)):
        return None
    letter = {c: b for b, c in byte_letters().items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in pairs]
    used = {*letter, *(a + b for a, b in pairs)}
    if any(x >= y for x, y in zip(made, made[1:])) or not used <= model["vocab"].keys():
        return None
    ranks = {bytes(letter[c] for c in t): model["vocab"][t] for t in used}
    return tiktoken.Encoding("units", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})._core_bpe


class UnitEncoder:
    """Token counts and ids of whole texts with the library's tokenizer at ``path``."""

    most = TABLE_UNITS

    def __init__(self, path: str, specials: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.whole.encode_special_tokens = not specials
        found = [t.content for t in self.whole.get_added_tokens_decoder().values()] if specials else []
        self.special = "|".join(map(re.escape, found))
        # a word can hold a special string of letters only (after a space, perhaps)
        self.special_words = any(re.fullmatch(f" ?[{LETTERS}]*", t) for t in found)
        self.ranked = rank_encoder(self.whole)
        self.table, self.old = Table(), Table()

    def _ask(self, groups: Iterable[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        sizes, ids = [], [np.zeros(0, "<u4")]
        for group in groups:
            found = [e.ids for e in self.whole.encode_batch_fast(group, add_special_tokens=False)]
            sizes += map(len, found)
            ids.append(np.array(list(chain.from_iterable(found)), "<u4"))
        return np.array(sizes, np.int64), np.concatenate(ids)

    def _recall(self, strings: list[str], slots: np.ndarray) -> np.ndarray:
        """Copy what the old table knows of new strings; the places of the others."""
        if not self.old.slots:
            return np.arange(len(strings))
        at = np.fromiter(map(self.old.slots.get, strings, repeat(-1)), np.int64, len(strings))
        known = np.flatnonzero(at >= 0)
        size = self.old.sizes[at[known]].astype(np.int64)
        self.table.put(slots[known], size, gather(self.old.begins[at[known]], size, self.old.ids))
        return np.flatnonzero(at < 0)

    def _kinds(self, new: pa.Array) -> np.ndarray:
        """Whether each unit is a plain word, another plain unit, or neither; only what may be mixed is matched further."""
        if not self.ranked:
            return np.full(len(new), ODD)
        short = pc.less_equal(pc.utf8_length(new), PLAIN_CHARS)
        word = pc.and_(short, pc.match_substring_regex(new, PLAIN_WORD))
        if self.special_words:
            word = pc.and_not(word, pc.match_substring_regex(new, self.special))
        kind = np.where(word.to_numpy(zero_copy_only=False), WORD, ODD)
        rest = np.flatnonzero(kind == ODD)
        others = new.take(pa.array(rest))
        plain = pc.and_(pc.match_substring_regex(others, PLAIN_UNIT), short.take(pa.array(rest)))
        if self.special:
            plain = pc.and_not(plain, pc.match_substring_regex(others, self.special))
        kind[rest[plain.to_numpy(zero_copy_only=False)]] = MIXED
        return kind

    def _learn(self, units: list[str], slots: np.ndarray) -> None:
        """Ids of new distinct units: plain ones by their ranks, others by the whole tokenizer."""
        rest = self._recall(units, slots)
        new = pa.array(units if len(rest) == len(units) else [units[i] for i in rest.tolist()], pa.large_string())
        kind = self._kinds(new)
        word, mixed, odd = (np.flatnonzero(kind == x) for x in (WORD, MIXED, ODD))
        if len(word) or len(mixed):
            found = list(map(self.ranked.encode_single_piece, objects(new.take(pa.array(word)).cast(pa.large_binary()))))
            found += map(self.ranked.encode_ordinary, objects(new.take(pa.array(mixed))))
            self.table.put(slots[rest[np.concatenate([word, mixed])]], np.fromiter(map(len, found), np.int64, len(found)),
                           np.array(list(chain.from_iterable(found)), "<u4"))
        if len(odd):
            self.table.put(slots[rest[odd]], *self._ask(byte_groups([units[i] for i in rest[odd].tolist()])))

    def lookup(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and number of the ids of each of some distinct units, and the ids they point into."""
        if self.table.full(self.most):
            self.old, self.table = self.table, Table()
        at, missing = self.table.find(units)
        if len(missing):
            try:
                self._learn([units[i] for i in missing.tolist()], at[missing])
            except BaseException:
                self.table = Table()  # holds slots without ids
                raise
        return self.table.begins[at], self.table.sizes[at].astype(np.int64), self.table.ids

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Token counts of the texts (nulls: empty), and all ids one after another."""
        texts = pc.fill_null(texts, "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        counts, ids, start = [], [], 0
        while start < len(texts):
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + CUT_BYTES, "right")))
            n, flat = self._encode(texts.slice(start, stop - start), want_ids)
            counts.append(n)
            ids.append(flat)
            start = stop
        pa.default_memory_pool().release_unused()  # what cutting took would stay beside the tables of every worker
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        return n, (np.concatenate(ids) if ids else np.zeros(0, "<u4")) if want_ids else None

    def _cut(self, texts: pa.Array) -> pa.Array:
        return cut_units(texts)

    def _encode(self, texts: pa.Array, want_ids: bool):
        lists = self._cut(texts)
        numbered = lists.flatten().dictionary_encode()
        index = numbered.indices.to_numpy()
        begin, size, ids = self.lookup(objects(numbered.dictionary))
        each = size[index]
        ends = np.concatenate([[0], np.cumsum(each)])
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy().astype(np.int64))])
        return np.diff(ends[first]), gather(begin[index], each, ids) if want_ids else None


def encoder(path: str, most: int | None = None) -> UnitEncoder:
    """The worker's encoder for this file, loaded once per process; ``most``: units of a full table."""
    cache, key = process_cache("units"), ("units", path)
    if key not in cache:
        cache[key] = UnitEncoder(path)
    cache[key].most = most or UnitEncoder.most
    return cache[key]
