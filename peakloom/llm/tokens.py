"""Token counts by prefix dynamic programming.

A byte-pair encoding is right exactly if each token is the encoding of its own bytes and each two neighbours are the
encoding of their joined bytes. So the last token of a prefix is the one token that ends there and fits the last
token of the shorter prefix it leaves: one pass over a piece of text stores, for each of its prefixes, the last token
and the exact count.

A text is cut by the tokenizer's own pattern into pieces that are encoded apart. Counts of a piece's prefixes, by
character, are worked out once for equal pieces; strung together they are the counts of all prefixes of the text, which
are put right where a prefix is cut into other pieces than the text: in runs of white space, of which the pattern leaves
the last blank to a following word, and in special strings. A budget question is a search over those counts and a
truncation a lookup; neither encodes anything. Characters about which regular expression libraries disagree only change
who finds the pieces: the tokenizer library's own splitter.

Cases: null counts as the empty text: 0 bytes, 0 tokens. A special string inside a text is one special token, as the
library's default has it. Very long texts and pieces take time in proportion to their length. A null id stays null,
repeated rows give repeated results, other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.llm.common import in_slices, map_arrow, text_of

#: With characters outside these ranges, or the listed control characters, a text is cut by the library's splitter.
_ODD = regex.compile(r"[\x1c-\x1f\x85ɐ-῿⁰-\U0010ffff]")
#: Runs of white space that a prefix can cut, as the library sees white space.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
#: Equal pieces and pairs of tokens are looked up; a process forgets them beyond so many.
_MOST_PIECES, _MOST_PAIRS = 1_000_000, 1_000_000
#: Pieces beyond so many bytes aren't kept.
_KEPT = 256


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letters that stand for bytes 0 to 255 in byte-level vocabularies: printable ones for themselves, the
    others for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    return [chr(other.get(b, b)) for b in range(256)]


class _Steps(dict):
    """By piece the steps of its prefix counts, one a character, as bytes; worked out when first asked for."""

    def __init__(self, owner: PrefixCounter):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        steps = self.owner.steps(piece)
        if len(piece) <= _KEPT:
            if len(self) >= _MOST_PIECES:
                self.clear()
            self[piece] = steps
        return steps


_STEP = np.dtype(np.int32)
_ZERO, _ONE = (np.array([n], _STEP).tobytes() for n in (0, 1))


def _last_word(pieces: list[str]) -> str:
    """The end of a text by its pieces: from the white space before its last word on."""
    k = len(pieces)
    while k and pieces[k - 1].isspace():
        k -= 1
    k = max(0, k - 1)
    while k and pieces[k - 1].isspace():
        k -= 1
    return "".join(pieces[k:])


class PrefixCounter:
    """Counts of a byte-level BPE tokenizer file, without begin, end or padding tokens."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        special = [t["content"] for t in spec["added_tokens"]]
        self.token_of = {bytes(byte_of[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
        self.bytes_of = {i: b for b, i in self.token_of.items()}
        pair = lambda m: m if isinstance(m, list) else m.split(" ")
        self.rank = {tuple(bytes(byte_of[c] for c in side) for side in pair(m)): r for r, m in enumerate(spec["model"]["merges"])}
        self._reach: dict[bytes, int] = {}
        for token in self.token_of:
            if len(token) > 3 and self._reach.get(token[-4:], 0) < len(token):
                self._reach[token[-4:]] = len(token)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.special_strings = tuple(special)
        self.pattern = regex.compile(pattern or public_tokenizers.PATTERN)
        self._fits: dict[tuple[int, int], bool] = {}
        self._steps = _Steps(self)
        self._cuts: dict[tuple[str, str], np.ndarray] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: join the pair of lowest rank, leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def fits(self, left: int, right: int) -> bool:
        """Whether right can follow left (-1: the start) in an encoding."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= _MOST_PAIRS:
                self._fits.clear()
            a, b = self.bytes_of.get(left, b""), self.bytes_of[right]
            known = self._fits[key] = self.merged(a + b) == ([a, b] if a else [b])
        return known

    def table(self, piece: bytes) -> tuple[list[int], list[int]]:
        """For each prefix length from 0: its token count and its last token (-1 at 0)."""
        count, last, token_of, fits, reach = [0], [-1], self.token_of, self._fits, self._reach.get
        for end in range(1, len(piece) + 1):
            # no token that ends in these four bytes is longer than reach says
            low = end - reach(piece[end - 4 : end], 3) if end > 3 else 0
            for start in range(low if low > 0 else 0, end):
                part = piece[start:end]
                if part in token_of:
                    token, before = token_of[part], last[start]
                    ok = fits.get((before, token))
                    if ok is None:
                        ok = self.fits(before, token)
                    if ok:
                        count.append(count[start] + 1)
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count, last

    def steps(self, piece: str) -> bytes:
        """The steps of a piece's prefix counts, one a character."""
        if piece.isascii() and piece[0] != "'":
            count = self.table(piece.encode())[0]
            return array(_STEP.char, map(sub, count[1:], count)).tobytes()
        return np.diff(self.piece_counts(piece)).astype(_STEP).tobytes()

    def piece_counts(self, piece: str) -> np.ndarray:
        """Token counts of a piece's prefixes, by characters from 0. A contraction is the one kind of piece of which a
        part is cut further."""
        data = piece.encode()
        count = np.array(self.table(data)[0], np.int64)
        if len(data) > len(piece):
            start = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            count = count[np.append(np.flatnonzero(start), len(data))]
        if piece[0] == "'" and len(piece) > 1 and piece[1:].isalpha():
            for n in range(1, len(piece)):
                count[n] = sum(self.table(x.encode())[0][-1] for x in self.pattern.findall(piece[:n]))
        return count

    def piece_tokens(self, piece: str) -> list[int]:
        """The token ids of a piece, from its table's last tokens."""
        data = piece.encode()
        _, last = self.table(data)
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """The text between special strings, and those strings (marked True)."""
        if not any(s in text for s in self.special_strings):
            return [(text, False)]
        return [(x, k % 2 == 1) for k, x in enumerate(self.special.split(text)) if x]

    def pieces(self, part: str) -> list[str]:
        """The pieces of a text without special strings."""
        if _ODD.search(part):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return self.pattern.findall(part)

    def prefix_counts(self, text: str) -> np.ndarray:
        """The token counts of text[:n] for n from 0 to the text's length."""
        steps, specials, at, own = [_ZERO], [], 0, []
        for part, special in self.segments(text):
            if special:
                specials.append((at, part, _last_word(own)))
                steps.append(_ZERO * (len(part) - 1) + _ONE)
                own = []
            else:
                own = self.pieces(part)
                steps += map(self._steps.__getitem__, own)
            at += len(part)
        counts = np.cumsum(np.frombuffer(b"".join(steps), _STEP), dtype=np.int64)
        for m in _RUN.finditer(text):
            # a prefix that ends in a run has what it has of the run as one piece
            a, b = m.span()
            counts[a + 1 : b + 1] = counts[a] + np.cumsum(np.frombuffer(self._steps[m[0]], _STEP))
        for at, part, context in specials:
            # a prefix that ends in a special string has its first characters after the word before it
            counts[at + 1 : at + len(part)] = counts[at - len(context)] + self._cut_special(context, part)
        return counts

    def _cut_special(self, context: str, special: str) -> np.ndarray:
        """Token counts of the context and the first characters of a special string, one of them to all but one."""
        known = self._cuts.get((context, special))
        if known is None:
            known = np.array([sum(np.frombuffer(self._steps[x], _STEP).sum() for x in self.pieces(context + special[:n])) for n in range(1, len(special))], np.int64)
            if len(context) <= _KEPT:
                if len(self._cuts) >= _MOST_PIECES:
                    self._cuts.clear()
                self._cuts[context, special] = known
        return known

    def count(self, text: str) -> int:
        return int(self.prefix_counts(text)[-1])

    def prefixes(self, text: str) -> PrefixTable:
        return PrefixTable(self.prefix_counts(text))


class PrefixTable:
    """Exact token counts of every prefix of one text, by characters; questions are answered from them alone."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    @classmethod
    def from_steps(cls, steps: bytes) -> PrefixTable:
        """The table that steps() has written."""
        return cls(np.append(0, np.cumsum(np.frombuffer(zlib.decompress(steps), _STEP), dtype=np.int64)))

    def steps(self) -> bytes:
        """The table as the steps from one prefix to the next, compressed, to be kept beside the text."""
        return zlib.compress(np.diff(self.counts).astype(_STEP).tobytes(), 1)

    def at(self, n_chars: int) -> int:
        """Tokens of text[:n_chars]."""
        return int(self.counts[max(0, min(n_chars, len(self.counts) - 1))])

    def longest_within(self, budget: int) -> int:
        """The most characters from the start of which the text takes at most budget tokens. Counts may fall from one
        character to the next, so it is the last place, not the first."""
        if self.counts[-1] <= budget:
            return len(self.counts) - 1
        return int(np.flatnonzero(self.counts <= budget)[-1]) if budget >= 0 else 0

    def chars_at(self, tokens: int) -> int:
        """The first place at which at least so many tokens are used, the text's length if there is none."""
        found = np.flatnonzero(self.counts >= tokens)
        return int(found[0]) if len(found) else len(self.counts) - 1


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The process's counter of a tokenizer file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def prefix_tables(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens and steps, the table of all its prefixes (PrefixTable)."""
    return _mapped(docs, tokenizer, id_col, text_col, "n_bytes long, n_tokens long, steps binary", lambda text, table: (len(text.encode()), table.at(len(text)), table.steps()))


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and fit_chars, the most
    characters from its start that take at most limit tokens."""
    out = _mapped(docs, tokenizer, id_col, text_col, "n_bytes long, n_tokens long, fit_chars long", lambda text, table: (len(text.encode()), table.at(len(text)), table.longest_within(limit)))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars")


def truncated(docs: DataFrame, budget: int, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, text cut to the most characters within budget tokens, n_tokens of the cut text."""

    def trim(text: str, table: PrefixTable) -> tuple:
        n = table.longest_within(budget)
        return text[:n], table.at(n)

    return _mapped(docs, tokenizer, id_col, text_col, "text string, n_tokens long", trim)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _mapped(docs: DataFrame, tokenizer: str | None, id_col: str, text_col: str, columns: str, answer) -> DataFrame:
    """doc_id and the columns that answer(text, its table) gives for each document."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    names, kinds = zip(*[x.split() for x in columns.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in in_slices(batches):
            made = [answer(t, own.prefixes(t)) for t in batch.column(1).to_pylist()]
            values = zip(*made, strict=True) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(v), _KINDS[k]) for v, k in zip(values, kinds, strict=True)]], ["doc_id", *names])

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")
