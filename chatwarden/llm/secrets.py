"""Secret scans with a token-efficiency test (operator 4).

Three fixed patterns find assigned secrets, access keys and long hex strings.
The method adds strings that a tokenizer's vocabulary cannot shorten: a run of
key characters whose number of characters per token is low is random. Known
digests and UUIDs are cut out first, and so is what a pattern has found already;
each remaining piece is a run of its own. Parts of a run that the vocabulary does
shorten are words; a run that mostly consists of them is no key as a whole, and
only its stretches without words are tested. Nor is a run that signs cut into
short parts of letters of one case or of digits (paths, names of many words,
versions), whatever the vocabulary makes of them, or one of few different
characters. Digests in base64 are known by the name of their kind before them;
without it they cannot be told from keys of the same length, and are reported.

Defined cases: a NULL or empty text has no spans; texts are scanned whole;
repeated rows get the same result each; an empty table gives an empty result;
columns of the input that have the name of an added one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, types as T

from chatwarden.llm.common import fields, map_texts
from chatwarden.llm.words import worker_cache

KINDS = ("assign", "access", "hex", "random")
# The patterns of the contract. \x20 is the space.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32

#: Strings of key characters that the token test looks at.
CANDIDATE_CHARS = 20
CHARS_PER_TOKEN = 2.0
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE_CHARS)
#: Parts of at least so many letters and characters per token are words.
WORD_CHARS, WORD_CHARS_PER_TOKEN = 4, 3.0
#: Common digests by their lengths in hex digits, and UUIDs; nothing else of letters or digits beside them.
_KNOWN = re.compile(
    r"(?<![0-9a-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?![0-9a-z])"
    r"|(?<![0-9a-z])(?:md5|sha1|sha256|sha384|sha512)-[0-9a-z+/]{22,86}={0,2}(?![0-9a-z+/=])",
    re.I,
)
#: A key has so many different characters at least.
DISTINCT_CHARS = 6
#: Parts between signs that are no longer than this and of one kind are those of a name.
NAME_CHARS = 12
_NAME_PART = re.compile(r"[A-Z]+|[A-Z]?[a-z]+|[0-9]+")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

_KEY_BYTE = np.array([chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") for b in range(256)])
_HEX_BYTE = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_WORDS = re.compile(rb"passw|secret|token|api_?key", re.IGNORECASE)


def _runs(raw: np.ndarray, kind: np.ndarray, least: int) -> bool:
    """Whether ``raw`` has ``least`` bytes of a kind in a row."""
    if len(raw) < least:
        return False
    other = np.flatnonzero(~kind[raw])
    gaps = np.diff(other, prepend=-1, append=len(raw)) - 1
    return bool(gaps.max() >= least)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the patterns' matches, leftmost and without overlap per kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if len(m[0]) >= HEX_CHARS]
    return sorted(found)


class TokenTest:
    """Characters per token of a string under a rank file of tiktoken."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, text: str) -> float:
        return len(text) / max(1, len(self.encoding.encode_ordinary(text)))

    def word(self, part: str) -> bool:
        """Whether the vocabulary shortens letters as it does a word's, behind a space or not."""
        return len(part) >= WORD_CHARS and max(self.ratio(part), len(part) / len(self.encoding.encode_ordinary(" " + part.lower()))) >= WORD_CHARS_PER_TOKEN

    def random_parts(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of what is random in a run of key characters: all between digests and
        UUIDs if few of its characters are in words, or else its stretches without words."""
        return [found for start, end in _between(0, len(text), _spans(_KNOWN, text)) for found in self._random(text, start, end)]

    def _random(self, text: str, start: int, end: int) -> list[tuple[int, int]]:
        piece = text[start:end]
        if len(set(piece)) < DISTINCT_CHARS or _is_name(piece):
            return []
        words = [m for m in _PART.finditer(piece) if self.word(m[0])]
        signs = len(piece) - sum(c.isalnum() for c in piece)
        letters = any(c.isalpha() for c in piece)
        if letters and 2 * sum(len(m[0]) for m in words) < len(piece) - signs:
            return [(start, end)] if self.ratio(piece) < CHARS_PER_TOKEN else []
        # Numbers joined by signs (dates, telephone numbers) are no key, so each is looked at alone.
        breaks = [m.span() for m in words] if letters else _spans(re.compile("[^0-9]+"), piece)
        return [
            (start + a, start + b) for a, b in _between(0, len(piece), breaks) if self.ratio(piece[a:b]) < CHARS_PER_TOKEN
        ]


def _is_name(piece: str) -> bool:
    """Whether two thirds of the letters and digits are in short parts of one kind, three parts or more."""
    parts = [p for p in re.split("[^A-Za-z0-9]+", piece) if p]
    named = sum(len(p) for p in parts if len(p) <= NAME_CHARS and _NAME_PART.fullmatch(p))
    return len(parts) >= 3 and 3 * named >= 2 * sum(map(len, parts))


def _spans(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in pattern.finditer(text)]


def _between(start: int, end: int, breaks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of a run without the breaks, if long enough for a candidate."""
    out = []
    for a, b in breaks:
        out.append((start, a))
        start = max(start, b)
    return [(a, b) for a, b in [*out, (start, end)] if b - a >= CANDIDATE_CHARS]


def _test(rank_file: str, pattern: str) -> TokenTest:
    key, cache = f"token test {rank_file} {pattern}", worker_cache()
    if key not in cache:
        cache[key] = TokenTest(rank_file, pattern)
    return cache[key]


def _scan(raw: bytes, test: TokenTest) -> list[tuple[int, int, int]]:
    """All spans. Patterns are only run on texts that hold what they need."""
    codes = np.frombuffer(raw, np.uint8)
    may_hex, may_key = _runs(codes, _HEX_BYTE, HEX_CHARS), _runs(codes, _KEY_BYTE, CANDIDATE_CHARS)
    if not (may_hex or may_key or b"AKIA" in raw or _WORDS.search(raw)):
        return []
    text = raw.decode()
    found = base_spans(text)
    if may_key:
        taken, at, rest = found, 0, []
        for m in _CANDIDATE.finditer(text):
            while at < len(taken) and taken[at][2] <= m.start():
                at += 1
            inside = itertools.takewhile(lambda x: x[0] < m.end(), taken[at:])
            for start, end in _between(m.start(), m.end(), ((s, e) for s, _, e in inside)):
                rest += [(start + a, 3, start + b) for a, b in test.random_parts(text[start:end])]
        found = found + rest
    return sorted(found)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds ``n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    A span is kind:start:end in code points, the end exclusive; ``base_sha256``
    is of the patterns' spans, ``spans`` has all.
    """

    def work(texts: list[bytes]):
        test = _test(rank_file, pattern)
        all_spans = [_scan(t, test) for t in texts]
        base = [[x for x in spans if x[1] < 3] for spans in all_spans]
        counts = [[sum(x[1] == k for x in spans) for spans in all_spans] for k in range(4)]
        digests = [hashlib.sha256(_listed(spans).encode()).hexdigest() for spans in base]
        return *counts, digests, [_listed(spans) for spans in all_spans]

    added = fields(
        n_assign=T.LongType(),
        n_access=T.LongType(),
        n_hex=T.LongType(),
        n_random=T.LongType(),
        base_sha256=T.StringType(),
        spans=T.StringType(),
    )
    return map_texts(docs, text, added, work)
