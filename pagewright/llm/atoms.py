"""Byte-level BPE of whole texts through a dictionary of space-delimited parts.

The split pattern of the byte-level vocabularies never joins two matches across a single space that stands between
two non-space characters: the space opens the match to its right, and no match to its left can reach it. Hence the
ids of a text are those of its parts, each encoded with its space, one after another. Texts with parts that touch
further white space are encoded in stretches that reach from one such place to the next, so the result is always
that of the whole text. Each batch's distinct parts are looked up once (Arrow does the splitting and the
dictionary), and a text's ids are gathered from them by numpy. The caches are bounded, keep what came first, which
holds the frequent parts, and start anew where most parts are missing; they only save time.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from pagewright.llm.common import cache

CACHE, LONGEST = 600_000, 48


def is_plain(part: str) -> bool:
    return part != "" and not part[0].isspace() and not part[-1].isspace()


class AtomEncoder:
    """pattern: splits a text into matches; encode_piece: one match -> id bytes (little-endian unsigned 32-bit).

    added: strings that are tokens of their own wherever they stand, with their ids; what lies between is split by itself.
    """

    def __init__(self, pattern: str, encode_piece: Callable[[str], bytes], added: dict[str, int] | None = None, cache_size: int = CACHE):
        self.size = cache_size
        self.added = {k: struct.pack("<I", v) for k, v in (added or {}).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.findall, self.encode_piece = regex.compile(pattern).findall, encode_piece
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The id bytes of one text, match by match."""
        return b"".join(map(self._piece, self.findall(text)))

    def _piece(self, p: str) -> bytes:
        v = self.pieces.get(p)
        if v is None:
            v = self.encode_piece(p)
            if len(p) <= LONGEST and len(self.pieces) < self.size:
                self.pieces[p] = v
        return v

    def _part(self, p: str) -> bytes | None:
        """The ids of a space and this part; None if the part is not plain."""
        if not is_plain(p):
            return None
        if p.isalpha():  # a single match, which the parts alone hold
            v = self.encode_piece(" " + p)
        elif p[-1] in ".,;:!?" and p[:-1].isalpha():
            v = (self.parts.get(p[:-1]) or self._part(p[:-1])) + self._piece(p[-1])
        else:
            v = self.encode(" " + p)
        if len(p) <= LONGEST and len(self.parts) < self.size:
            self.parts[p] = v
        return v

    def stretches(self, text: str) -> bytes:
        parts = text.split(" ")
        plain = list(map(is_plain, parts))
        runs = [[parts[0]]]
        for k in range(1, len(parts)):
            if plain[k] and plain[k - 1]:
                runs.append([parts[k]])
            else:
                runs[-1].append(parts[k])
        first, *rest = (" ".join(r) for r in runs)
        return self.encode(first) + b"".join(self.encode(" " + r) for r in rest)

    def encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the places where each text's ids start and the last one's end)."""
        cut = [k for k, t in enumerate(texts) if any(x in t for x in self.added)] if self.added else []
        if not cut:
            return self._encode_batch(texts)
        own = {k: b"".join(self.added.get(x) or self.stretches(x) for x in self.cut.split(texts[k]) if x) for k in cut}
        ids, at = self._encode_batch([t if k not in own else "" for k, t in enumerate(texts)])
        parts = [np.frombuffer(own[k], "<u4") if k in own else ids[at[k] : at[k + 1]] for k in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(1, np.int64)
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = np.asarray(split.offsets, dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        which = np.asarray(coded.indices, dtype=np.int64)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.parts.get, names))
        if None in values:
            if len(self.parts) >= self.size and 2 * values.count(None) > len(values):  # other texts than those the caches were filled with
                self.parts.clear()
                self.pieces.clear()
            for k, v in enumerate(values):
                if v is None:
                    values[k] = self._part(names[k])
        bad = np.fromiter((v is None for v in values), bool, len(values)) if None in values else None
        heads = [names[k] for k in which[begin[:-1]]]
        odd: list[int] = []
        if bad is not None:  # those in which a part, the first included, touches further white space
            hit = np.maximum.reduceat(bad[which], begin[:-1]) & (np.diff(begin) > 1)
            odd = [k for k in np.flatnonzero(hit).tolist()]
        which = which.copy()
        which[begin[:-1]] = len(values) + np.arange(len(texts))  # the first part has no space before it
        skip = set(odd)
        values = [v or b"" for v in values] + [b"" if k in skip else self.encode(h) for k, h in enumerate(heads)]
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        pool = np.frombuffer(b"".join(values), "<u4")
        first = np.cumsum(size) - size
        if odd:
            which[np.repeat(np.isin(np.arange(len(texts)), odd), np.diff(begin))] = len(values) - len(texts) + odd[0]  # empty
        count = size[which]
        total = int(count.sum())
        shift = np.repeat(first[which] - (np.cumsum(count) - count), count)
        ids = pool[shift + np.arange(total)]
        at = np.concatenate([[0], np.cumsum(count)])[begin]
        if odd:
            out = [ids[a:b] for a, b in zip(at[:-1], at[1:])]
            for k in odd:
                out[k] = np.frombuffer(self.stretches(texts[k]), "<u4")
            return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])
        return ids, at


def byte_names() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


_ENCODERS: dict[str, AtomEncoder] = cache()


def tokenizers_encoder(path: str) -> AtomEncoder:
    """Over a byte-level tokenizer file of the tokenizers library; one for each worker process and path.

    Added tokens of the file that a text spells out are these tokens, as the library has it. Its model merges each match.
    """
    if path not in _ENCODERS:
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model, added = whole.model, {t.content: k for k, t in whole.get_added_tokens_decoder().items()}
        table = str.maketrans({chr(b): c for b, c in byte_names().items()})
        space, pack = byte_names()[32], [struct.Struct(f"<{n}I").pack for n in range(9)]

        def encode_piece(piece: str) -> bytes:
            name = space + piece[1:] if piece[0] == " " and piece[1:].isascii() and piece[1:].isalpha() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
            ids = [t.id for t in model.tokenize(name)]
            return pack[len(ids)](*ids) if len(ids) < 9 else np.array(ids, "<u4").tobytes()

        _ENCODERS[path] = AtomEncoder(PATTERN, encode_piece, added)
    return _ENCODERS[path]
