"""Token ids in Re-Pair compressed shards (operator 5).

Texts are put in order of their ids by range partitions, encoded with a byte
BPE vocabulary, and written as shards: Parquet rows that hold the documents'
ids and lengths and the ids of all their tokens, compressed by a grammar.

The grammar is built by Re-Pair in rounds. A round counts all neighboring pairs
of symbols and gives the frequent ones nonterminals, the most frequent first; a
symbol is only taken as left or only as right side, so the pairs of a round
never overlap and are all replaced at once. The end of a document is a symbol
of its own that no rule takes, so each document is a slice of the shard's
symbols and can be decoded alone; the stored expansion lengths lead to any
token of it without decoding what is before.

Encoding works piece by piece: a single space between other characters always
starts a new piece of the vocabulary's pattern, and so does a change between
ASCII letters, digits and signs (but not behind an apostrophe). The ids of a text
are those of its pieces, one after the other. Pieces are found and looked up by
64-bit hashes in blocks; only pieces that a worker has not met yet go through
the tokenizer. Of these, pieces of ASCII letters, digits or signs alone are what
the vocabulary's pattern would leave whole, so they go to its BPE model without
the pattern. Texts with other runs of white space or with a special token's
string are encoded whole.

Defined cases: a NULL or empty text is the end id alone; documents of one id
stand in order of a hash of their text, a NULL id stands first; repeated rows
are stored each; an empty table gives files without rows; a text of any length
is one document, and a shard holds at least one document.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from chatwarden.session import scratch_path, small_batches
from chatwarden.llm.common import as_bytes, fields, map_batches
from chatwarden.llm.words import blocks, mix, release, worker_cache

SHARD_TOKENS = 1 << 21
END_ID = 0
ROUNDS = 6
MIN_PAIR = 24  # rarer pairs get no rule
_SHORT = 1 << 16  # symbols below this take two bytes; rules stop there if the vocabulary leaves room
_BLOCK = 1 << 20
_SLOT_BITS = 20
_SLOTS = 1 << _SLOT_BITS  # counters of a round
_MAX_WORDS = 1_500_000  # words that a worker remembers; then it starts anew
_NEAR_BITS = 20
_TOGETHER = 48  # new pieces that go through the tokenizer as one text
_SPACE_LETTER = "\u0120".encode()  # a space in tokens of a byte vocabulary
_UNEVEN = re.compile(r"\s |^ | $")  # spaces that may not start a piece
#: Bytes that are, or may end, a character of white space.
_MAY_BE_SPACE = np.zeros(256, bool)
_SPACES = [c.encode() for c in map(chr, range(0x3001)) if c.isspace()]
_MAY_BE_SPACE[[c[-1] for c in _SPACES]] = True
_WIDE_SPACES = np.array([int.from_bytes(c) for c in _SPACES if len(c) > 1])


def _piece_class(byte: int) -> int:
    """0 space, 1 letter, 2 digit, 3 sign, 4 no piece starts here or behind, 5 white space, 6 apostrophe."""
    char = chr(byte)
    if byte == 0x20:
        return 0
    if byte == 0x27:
        return 6
    if 0x09 <= byte <= 0x0D:
        return 5
    if byte < 0x20 or byte >= 0x7F:
        return 4
    return 1 if char.isalpha() else 2 if char.isdigit() else 3


_CLASSES = 7
_CLASS = bytes(_piece_class(b) for b in range(256))
_CUTS = {(a, b) for a in (1, 2, 3) for b in (1, 2, 3, 5, 6) if a != b} - {(3, 6)}


def _edge(before: int, here: int) -> int:
    """1 where a piece starts, 2 where one ends, 3 where one ends and the next starts."""
    if before and here:
        return 3 if (before, here) in _CUTS else 0
    return 1 if here else 2 if before else 0


#: For the classes of two neighboring bytes, as one number: what is between them.
_EDGE = bytes(_edge(*divmod(i, _CLASSES)) if i < _CLASSES**2 else 0 for i in range(256))
#: Bytes of pieces that may hold more than one match of the vocabulary's pattern.
_ODD = bytes(c in (4, 5, 6) for c in _CLASS)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


@dataclass
class Pieces:
    """Pieces of a block. ``first[d]`` to ``first[d + 1]`` are the pieces of text ``d``."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def find_pieces(texts: list[bytes]) -> Pieces:
    """Runs without spaces, cut where the class of their bytes changes."""
    data = b" ".join([b"", *texts, b""])  # with a space before and behind
    kind = np.frombuffer(data.translate(_CLASS), np.uint8)
    pair = kind[:-1] * np.uint8(_CLASSES)
    pair += kind[1:]
    edge = np.frombuffer(pair.tobytes().translate(_EDGE), np.uint8)
    start, end = np.flatnonzero((edge & 1).view(bool)) + 1, np.flatnonzero((edge >> 1).view(bool)) + 1
    offset = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) + 1
    first = np.searchsorted(start, np.concatenate([[1], offset]))
    return Pieces(data, start, end, first, _hash(data, start, end - start))


def _hash(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of parts of ``data``, eight bytes at a time."""
    eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = mix(out + (eight[start] & _MASK.take(np.minimum(size, 8))))
    at, done = np.flatnonzero(size > 8), 8
    while len(at):
        left = size[at] - done
        out[at] = mix(out[at] + (eight[start[at] + done] & _MASK.take(np.minimum(left, 8))))
        at, done = at[left > 8], done + 8
    return out


_SHARD = fields(
    part=T.LongType(),
    shard=T.LongType(),
    n_tokens=T.LongType(),
    first=T.LongType(),
    doc_ids=T.BinaryType(),
    doc_symbols=T.BinaryType(),
    doc_tokens=T.BinaryType(),
    symbols=T.BinaryType(),
    rules=T.BinaryType(),
    lengths=T.BinaryType(),
    no_id=T.BinaryType(),
)


# --- encoding -----------------------------------------------------------------------


class WordEncoder:
    """Ids of whole texts; remembers the ids of words by hash."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        (self.line_end,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        pattern = self.tokenizer.pre_tokenizer
        self.model = None  # the vocabulary without its pattern
        if isinstance(pattern, pre_tokenizers.ByteLevel) and pattern.use_regex and isinstance(self.tokenizer.model, models.BPE):
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            vocabulary = self.tokenizer.get_vocab()
            self.length = np.zeros(max(vocabulary.values()) + 1, np.int32)  # bytes of a token
            for token, i in vocabulary.items():
                self.length[i] = len(token)
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int32)
        self.ids = np.zeros(0, np.uint16 if self.tokenizer.get_vocab_size() <= _SHORT else np.uint32)
        # One word for each value of a key's first bits is found without a search.
        self.near_key = np.zeros(1 << _NEAR_BITS, np.uint64)
        self.near_slot = np.full(1 << _NEAR_BITS, -1, np.int32)

    def encode(self, texts: list[bytes]) -> list[np.ndarray] | tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds per text)."""
        uneven = self._uneven(texts)
        even = [b"" if u else t for t, u in zip(texts, uneven)]
        found = find_pieces(even)
        keys = found.hash.copy()
        bare = np.ones(len(keys), bool)  # without a space before it
        bare[1:] = found.start[1:] == found.end[:-1]
        bare[found.first[:-1][np.diff(found.first) > 0]] = True
        keys[bare] = mix(keys[bare] + np.uint64(1))
        slots = self._slots(found, keys, bare)
        sizes = np.diff(self.start)[slots]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[_ranges(self.start[slots], sizes)].astype(np.uint32)
        bounds = ends[found.first]
        if any(uneven):
            parts = [ids[s:e] for s, e in zip(bounds[:-1], bounds[1:])]
            for i, whole in zip(np.flatnonzero(uneven), self._whole([t for t, u in zip(texts, uneven) if u])):
                parts[i] = whole
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts)
        return ids, bounds

    def _uneven(self, texts: list[bytes]) -> list[bool]:
        """Which texts have runs of white space or a special token's string. Most are ruled
        out together: no space of theirs stands behind a byte that may be white space."""
        data = b" ".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        behind = np.ones(len(raw), bool)  # as the first text has no space before it
        behind[1:] = _MAY_BE_SPACE[raw[:-1]]
        at = np.flatnonzero((raw == 0x20) & behind)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        # Most bytes that may end a character of white space end another one.
        wide = raw[at - 1] >= 0x80
        code = (raw[at - 2].astype(np.int32) << 8) | raw[at - 1]
        code = np.where(raw[at - 2] == 0xC2, code, (raw[at - 3].astype(np.int32) << 16) | code)
        at = at[~wide | np.isin(code, _WIDE_SPACES)]
        maybe = np.zeros(len(texts), bool)
        # The space itself or, where it only parts two texts, the byte before it.
        maybe[np.searchsorted(ends, at, "right")] = True
        out = [bool(m and _UNEVEN.search(t.decode())) for t, m in zip(texts, maybe.tolist())]
        for x in self.special:
            if x in data:
                out = [u or x in t for t, u in zip(texts, out)]
        return out

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in made]

    def _slots(self, found: Pieces, keys: np.ndarray, bare: np.ndarray) -> np.ndarray:
        place = (keys >> np.uint64(64 - _NEAR_BITS)).astype(np.intp)
        slots = self.near_slot.take(place).astype(np.int64)
        rest = np.flatnonzero((self.near_key.take(place) != keys) | (slots < 0))
        if len(rest):
            far = self._search(found, keys[rest], bare[rest], rest)
            if far is None:  # all is forgotten
                return self._slots(found, keys, bare)
            slots[rest] = far
        return slots

    def _search(self, found: Pieces, keys: np.ndarray, bare: np.ndarray, at: np.ndarray) -> np.ndarray | None:
        """Slots of the words ``at``; new ones are encoded. None if there is no room for these."""
        distinct, first_at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        slot = np.full(len(distinct), -1)
        known = np.flatnonzero(place < len(self.keys))
        known = known[self.keys[place[known]] == distinct[known]]
        slot[known] = self.slots[place[known]]
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.keys) + len(new) > _MAX_WORDS and len(self.keys):
                self._forget()
                return None
            ids, sizes = self._encode_pieces(found, at[first_at[new]], bare[first_at[new]])
            slot[new] = len(self.keys) + np.arange(len(new))
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(sizes, dtype=np.int32)])
            self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
            self.slots = np.insert(self.slots, place[new], slot[new])
            self.keys = np.insert(self.keys, place[new], distinct[new])
            near = (distinct[new] >> np.uint64(64 - _NEAR_BITS)).astype(np.intp)
            near, chosen = np.unique(near, return_index=True)
            free = self.near_slot[near] < 0
            self.near_key[near[free]] = distinct[new[chosen[free]]]
            self.near_slot[near[free]] = slot[new[chosen[free]]]
        return slot[inverse]

    def _encode_pieces(self, found: Pieces, at: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces ``at``, one piece after the other; how many each has)."""
        raw = np.frombuffer(found.data, np.uint8)
        start, end = found.start[at], found.end[at]
        odd = np.flatnonzero(np.frombuffer(found.data.translate(_ODD), bool))
        alike = np.searchsorted(odd, start) == np.searchsorted(odd, end)
        groups = []
        part = np.flatnonzero(alike)
        made = self._alike(raw, start[part], end[part], bare[part])
        if made is None:
            alike[:] = False
        else:
            groups.append((part, *made))
        line_ends = np.flatnonzero(raw == 0x0A)
        alone = ~alike & (bare | (np.searchsorted(line_ends, start) < np.searchsorted(line_ends, end)))
        for i in np.flatnonzero(~alike & ~alone & _MAY_BE_SPACE[raw[end - 1]]).tolist():
            alone[i] = found.data[start[i] : end[i]].decode()[-1].isspace()
        part = np.flatnonzero(~alike & ~alone)
        groups.append((part, *self._lines(raw, start[part], end[part])))
        part = np.flatnonzero(alone)
        spaces = np.where(bare[part], 0, 1).tolist()
        texts = [" " * n + found.data[a:b].decode() for n, a, b in zip(spaces, start[part].tolist(), end[part].tolist())]
        groups.append((part, *self._all(self.tokenizer, texts)))
        counts = np.zeros(len(at), np.int64)
        for part, _, sizes in groups:
            counts[part] = sizes
        to = np.cumsum(counts) - counts
        ids = np.zeros(int(counts.sum()), np.uint32)
        for part, made, sizes in groups:
            ids[_ranges(to[part], sizes)] = made
        return ids, counts

    def _alike(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces of ASCII letters, digits or signs alone by the model without its pattern,
        which would leave them whole. Where a piece ends is told by the lengths of its tokens. None
        if the model does not spell out the pieces byte by byte."""
        if self.model is None:
            return None
        size, marks = end - start, np.where(bare, 0, 2)  # a space is a letter of two bytes here
        line = np.concatenate([[0], np.cumsum(size + marks + 1)])
        data = np.full(line[-1], 0x20, np.uint8)
        spaced = line[:-1][~bare]
        data[spaced], data[spaced + 1] = _SPACE_LETTER
        data[_ranges(line[:-1] + marks, size)] = raw[_ranges(start, size)]
        data = data.tobytes()
        bounds = [*line[:-1:_TOGETHER].tolist(), len(data)]
        ids, _ = self._all(self.model, [data[a:b].decode() for a, b in zip(bounds[:-1], bounds[1:])])
        ends, wanted = np.cumsum(self.length.take(ids)), np.cumsum(size + ~bare)
        last = np.searchsorted(ends, wanted)
        if not len(ids) or last[-1] != len(ids) - 1 or (ends[last] != wanted).any():
            self.model = None if len(start) else self.model
            return None
        return ids, np.diff(last, prepend=-1)

    def _lines(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces behind a space, encoded as lines: the end of a line is an id of its own in
        front of a space, and the ids are cut there."""
        size = end - start
        line = np.concatenate([[0], np.cumsum(size + 2)])
        data = np.full(line[-1], 0x20, np.uint8)
        data[line[1:] - 1] = 0x0A
        data[_ranges(line[:-1] + 1, size)] = raw[_ranges(start, size)]
        data = data.tobytes()
        first = np.arange(0, len(start), _TOGETHER)
        bounds = [*line[first].tolist(), len(data)]
        lines, sizes = self._all(self.tokenizer, [data[a:b].decode() + " " for a, b in zip(bounds[:-1], bounds[1:])])
        cut = np.flatnonzero(lines == self.line_end)
        begin = np.concatenate([[0], cut[:-1] + 1]) if len(cut) else cut
        begin[first] = np.cumsum(sizes) - sizes
        return lines[_ranges(begin, cut - begin)], cut - begin

    def _all(self, tokenizer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the texts, one text after the other; how many each has)."""
        made = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        return np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum())), sizes


def _ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...``: as many numbers from each start as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(start - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def encoder(tokenizer_file: str) -> WordEncoder:
    """One per worker process, kept from task to task."""
    key, cache = f"encoder {tokenizer_file}", worker_cache()
    if key not in cache:
        cache[key] = WordEncoder(tokenizer_file)
    return cache[key]


# --- grammar ------------------------------------------------------------------------


class Grammar:
    """``rules[i]`` are the two symbols of nonterminal ``first + i``; ``lengths[i]`` is the
    number of terminals it stands for. Symbols below ``first`` are terminals."""

    def __init__(self, first: int, rules: np.ndarray, lengths: np.ndarray):
        self.first, self.rules, self.lengths = first, rules, lengths
        terminals = np.ones(first, np.int64)
        self.size = np.concatenate([terminals, lengths.astype(np.int64)])
        self.start = np.concatenate([np.arange(first), first + np.cumsum(lengths) - lengths]).astype(np.int64)
        flat = np.zeros(first + int(lengths.sum()), np.uint32)
        flat[:first] = np.arange(first)
        # Rules only use earlier symbols, so they are spelled out in order, round by round.
        done = 0
        while done < len(rules):
            ready = done + int(np.argmax(np.append((rules[done:] >= first + done).any(axis=1), True)))
            for side in (0, 1):
                symbol = rules[done:ready, side].astype(np.int64)
                to = self.start[first + done : first + ready]
                if side:
                    to = to + self.size[rules[done:ready, 0].astype(np.int64)]
                _copy(flat, to, self.start[symbol], self.size[symbol])
            done = ready
        self.flat = flat

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        sizes = self.size[symbols]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.start[symbols] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def decode_range(self, symbols: np.ndarray, start: int, stop: int) -> np.ndarray:
        """Terminals ``start`` to ``stop``; only the symbols that cover them are spelled out."""
        ends = np.cumsum(self.size[symbols.astype(np.int64)])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.decode(symbols[a:b])[start - before : stop - before]


def _copy(flat: np.ndarray, to: np.ndarray, source: np.ndarray, sizes: np.ndarray) -> None:
    step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat[np.repeat(to, sizes) + step] = flat[np.repeat(source, sizes) + step]


def repair(ids: np.ndarray, end: int, rounds: int = ROUNDS, min_pair: int = MIN_PAIR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, lengths) of ``ids``; the symbol ``end`` is in no rule and is the
    largest terminal.

    Pairs of old symbols only get rarer from round to round, as new ones stand between them. So a
    pair that was counted as too rare is not looked at again, unless one of its sides is new."""
    short = end < _SHORT // 8 * 7
    symbols = ids.astype(np.uint32)
    bits, kind = (16, np.uint32) if short else (32, np.uint64)
    rules: list[np.ndarray] = []
    size = np.ones(end + 1, np.int64)
    wait = np.ones(len(symbols), bool)
    for _ in range(rounds):
        n_symbols = len(size)
        plain = symbols != end
        wait[-1:] = False
        wait[:-1] &= plain[:-1] & plain[1:]
        del plain  # arrays of a shard's size go as soon as they are done with
        live = np.flatnonzero(wait).astype(np.int32)  # where pairs begin that may be frequent
        live, group, n_groups = _groups(symbols, live, min_pair)
        # A group counts the pair that owns it; pairs that lose theirs wait for the next round.
        code = (symbols.take(live).astype(kind) << kind(bits)) | symbols.take(live + 1)
        owner = np.zeros(n_groups, kind)
        owner[group] = code
        owned = owner.take(group) == code
        del code
        counts = np.bincount(group.compress(owned), minlength=n_groups)
        often = np.flatnonzero(counts >= min_pair)
        room = _SHORT - n_symbols if short else len(often)
        chosen = _sides(owner[often], counts[often], often, room, bits, n_symbols)
        if not len(chosen):
            break
        rule_of = np.full(n_groups, -2, np.int32)
        rule_of[often] = -1
        rule_of[chosen] = np.arange(len(chosen))
        rule = rule_of.take(group)
        rule[~owned] = -1
        del group, owned
        taken = np.flatnonzero(rule >= 0)
        at, place = live.take(taken), rule.take(taken)
        del taken
        pairs = owner[chosen]
        fresh = np.stack([pairs >> kind(bits), pairs & kind((1 << bits) - 1)], axis=1).astype(np.int64)
        # Only pairs of one symbol twice can follow each other closely: every second one counts.
        new_run = np.diff(at, prepend=-2) != 1
        first_of_run = np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
        even = (np.arange(len(at)) - first_of_run) % 2 == 0
        at, place = at.compress(even), place.compress(even)
        del new_run, first_of_run, even
        symbols[at] = n_symbols + place
        wait[:] = False
        wait[live.compress(rule > -2)] = True
        del live, rule
        wait[at] = wait[at - 1] = True  # the pairs of a new symbol; -1 is the last one, which begins none
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, wait = symbols.compress(keep), wait.compress(keep)
        del keep, at, place
        rules.append(fresh)
        size = np.concatenate([size, size[fresh[:, 0]] + size[fresh[:, 1]]])
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return symbols, table.astype(np.uint32), size[end + 1 :].astype(np.uint32)


def _groups(symbols: np.ndarray, live: np.ndarray, min_pair: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places of ``live`` whose pair may be there ``min_pair`` times, the number of its group, how
    many groups there are). A group is all pairs of one slot; most slots have too few of them."""
    slot = symbols[:-1] * np.uint32(0x9E3779B1)
    slot += symbols[1:] * np.uint32(0x85EBCA77)
    slot >>= np.uint32(32 - _SLOT_BITS)
    slot = slot.take(live).astype(np.intp)
    full = np.flatnonzero(np.bincount(slot, minlength=_SLOTS) >= min_pair)
    number = np.full(_SLOTS, -1, np.int32)
    number[full] = np.arange(len(full))
    group = number.take(slot)
    del slot
    stay = group >= 0
    return live.compress(stay), group.compress(stay), len(full)


def _sides(pairs: np.ndarray, counts: np.ndarray, slots: np.ndarray, room: int, bits: int, n_symbols: int) -> np.ndarray:
    """Slots of the pairs of a round, the most frequent first; a symbol stays on the side
    that it got first, so no two of the pairs can overlap."""
    side = bytearray(n_symbols)  # 0 none yet, 1 left, 2 right, 3 both of one pair
    chosen = []
    order = np.lexsort((pairs, -counts))
    left, right = pairs[order] >> pairs.dtype.type(bits), pairs[order] & pairs.dtype.type((1 << bits) - 1)
    for slot, a, b in zip(slots[order].tolist(), left.tolist(), right.tolist()):
        if a == b:
            if not side[a]:
                side[a] = 3
                chosen.append(slot)
        elif side[a] < 2 and not side[b] & 1:
            side[a], side[b] = 1, 2
            chosen.append(slot)
    return np.array(chosen[:room], np.int64)


# --- files --------------------------------------------------------------------------


def _pack(values: np.ndarray, kind="<u4") -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _unpack(data: bytes, kind="<u4") -> np.ndarray:
    return np.frombuffer(data, kind)


def _symbol_kind(n_symbols: int) -> str:
    return "<u2" if n_symbols <= _SHORT else "<u4"


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Writes the ids of all texts, with ``END_ID`` behind each, in ascending order of ids."""
    small_batches(docs.sparkSession)
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
        .repartitionByRange("id", "tie")
        .sortWithinPartitions("id", "tie")
        .withColumn("part", F.spark_partition_id().cast("long"))
        .select("id", "part", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_file)
        end = words.tokenizer.get_vocab_size()
        held_ids: list[np.ndarray] = []
        held_docs: list[int | None] = []
        held_sizes: list[int] = []
        total = shard = 0
        part = 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            part = batch.column(1)[0].as_py() if len(doc_ids) else part
            for at, texts in blocks(as_bytes(batch.column(2)), _BLOCK):
                ids, bounds = words.encode(texts)
                held_ids.append(np.insert(ids, bounds[1:], end))
                sizes = np.diff(bounds) + 1
                held_sizes.extend(sizes.tolist())
                held_docs.extend(doc_ids[at : at + len(texts)])
                total += int(sizes.sum())
                if total >= shard_tokens:
                    del texts, ids, bounds, sizes
                    yield _shard(part, shard, held_ids, held_docs, held_sizes, end)
                    held_docs, held_sizes, total, shard = [], [], 0, shard + 1
        if held_docs:
            yield _shard(part, shard, held_ids, held_docs, held_sizes, end)

    map_batches(ordered, run, _SHARD).write.parquet(path)


def _shard(part, shard, held_ids, held_docs, held_sizes, end) -> pa.RecordBatch:
    """Takes the ids out of ``held_ids``. What encoding took is given back before the grammar
    is built, and what that took before the shard leaves."""
    ids = np.concatenate(held_ids)
    held_ids.clear()
    release()
    symbols, rules, lengths = repair(ids, end)
    del ids
    release()
    ends = np.flatnonzero(symbols == end) + 1
    row = {
        "part": part,
        "shard": shard,
        "n_tokens": sum(held_sizes),
        "first": end + 1,
        "doc_ids": _pack(np.array([d or 0 for d in held_docs]), "<i8"),
        "doc_symbols": _pack(np.diff(ends, prepend=0)),
        "doc_tokens": _pack(np.array(held_sizes)),
        "symbols": _pack(symbols, _symbol_kind(end + 1 + len(rules))),
        "rules": _pack(rules),
        "lengths": _pack(lengths),
        "no_id": _pack(np.flatnonzero([d is None for d in held_docs])),
    }
    return pa.RecordBatch.from_pylist([row])


def _grammar(row: dict) -> tuple[Grammar, np.ndarray]:
    rules = _unpack(row["rules"]).reshape(-1, 2)
    symbols = _unpack(row["symbols"], _symbol_kind(row["first"] + len(rules)))
    return Grammar(row["first"], rules, _unpack(row["lengths"])), symbols


def decode_document(row: dict, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids of document ``number`` of a shard, or ids ``start`` to ``stop`` of it, from its own symbols."""
    grammar, symbols = _grammar(row)
    ends = np.cumsum(_unpack(row["doc_symbols"]))
    own = symbols[ends[number] - _unpack(row["doc_symbols"])[number] : ends[number]]
    size = int(_unpack(row["doc_tokens"])[number])
    ids = grammar.decode_range(own, start, size if stop is None else min(stop, size))
    return np.where(ids == grammar.first - 1, END_ID, ids).astype(np.uint32)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (unsigned 32-bit, little-endian) of every document."""
    return _read(spark, path, lambda ids: ids.astype("<u4").tobytes(), T.BinaryType(), "ids")


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document."""
    return _read(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), T.LongType(), "ids_crc32")


def _read(spark: SparkSession, path: str, what, kind: T.DataType, name: str) -> DataFrame:
    shards = spark.read.schema(_SHARD).parquet(path)
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, then the shards inside each of them.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.withColumn("offset", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part")
    places = places.select("part", "shard", (F.col("base") + F.col("offset")).alias("base"))
    schema = fields(part=T.LongType(), shard=T.LongType(), doc_id=T.LongType(), at=T.LongType(), n_tokens=T.LongType(), value=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar, symbols = _grammar(row)
                ids = grammar.decode(symbols)
                ids[ids == grammar.first - 1] = END_ID
                sizes = _unpack(row["doc_tokens"]).astype(np.int64)
                ends = np.cumsum(sizes)
                doc_ids = _unpack(row["doc_ids"], "<i8")
                missing = np.zeros(len(doc_ids), bool)
                missing[_unpack(row["no_id"]).astype(np.int64)] = True
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"])),
                        pa.array(np.full(n, row["shard"])),
                        pa.array(doc_ids, mask=missing),
                        pa.array(ends - sizes),
                        pa.array(sizes),
                        pa.array([what(ids[e - s : e]) for s, e in zip(sizes, ends)], pa.binary() if kind == T.BinaryType() else pa.int64()),
                    ],
                    names=schema.names,
                )

    rows = map_batches(shards, run, schema).join(places, ["part", "shard"])
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("value").alias(name))


def token_digests(docs: DataFrame, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files to the shared folder and reads the documents back from them."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file, doc_id, text)
    return read_token_digests(docs.sparkSession, path)
