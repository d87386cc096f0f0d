"""CCITT fax data (ITU-T T.4 and T.6): Group 4, and Group 3 of one or two dimensions.

A damaged line ends the image: what is left stays white, and the result says so.
"""

from __future__ import annotations

import numpy as np

# fixed values: codes of run lengths 0 .. 63, then 64, 128 .. 1728
_WHITE = (
    "00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 "
    "00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 "
    "01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100 "
    "11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 "
    "010011000 010011001 010011010 011000 010011011"
).split()
_BLACK = (
    "0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 "
    "00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001 000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 "
    "000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 "
    "000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111 "
    "0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010 0000001110011 "
    "0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101"
).split()
#: fixed values: codes of 1792, 1856 .. 2560, of either colour
_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()


def _runs(codes: list[str]) -> dict[str, int]:
    return {c: k if k < 64 else 64 * (k - 63) for k, c in enumerate(codes)} | {c: 1792 + 64 * k for k, c in enumerate(_LONG)}


RUNS = (_runs(_WHITE), _runs(_BLACK))
#: fixed values: two-dimensional modes; a number is how far the change lies from the one above
MODES = {"1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3, "0001": "pass", "001": "level"}
LONGEST = 13


class _Damaged(Exception):
    pass


class _Bits:
    def __init__(self, data: bytes):
        self.s, self.at = np.unpackbits(np.frombuffer(data, np.uint8)).astype(np.uint8).tobytes().translate(bytes.maketrans(b"\0\1", b"01")).decode(), 0

    def look(self, table: dict):
        for n in range(1, LONGEST + 1):
            v = table.get(self.s[self.at : self.at + n])
            if v is not None and self.at + n <= len(self.s):
                self.at += n
                return v
        raise _Damaged

    def run(self, black: int) -> int:
        total = 0
        while True:
            n = self.look(RUNS[black])
            total += n
            if n < 64:
                return total


def _level(bits: _Bits, columns: int) -> list[int]:
    """The places of the changes of a line coded by itself."""
    out, x, black = [], 0, 0
    while x < columns:
        x += bits.run(black)
        out.append(min(x, columns))
        black ^= 1
    return out


def _against(bits: _Bits, above: list[int], columns: int) -> list[int]:
    """The changes of a line coded against the one above."""
    out, a, black, k = [], -1, 0, 0
    while a < columns:
        k = max(0, k - 2)
        while k < len(above) and (above[k] <= a or k % 2 != black):  # the first change above to the other colour
            k += 1
        b1 = above[k] if k < len(above) else columns
        b2 = above[k + 1] if k + 1 < len(above) else columns
        mode = bits.look(MODES)
        if mode == "pass":
            a = b2
        elif mode == "level":
            start = max(a, 0)
            for c in (black, black ^ 1):
                start = min(columns, start + bits.run(c))
                out.append(start)
            a = start
        else:
            a = b1 + mode
            if a < (out[-1] if out else 0) or a > columns:
                raise _Damaged
            out.append(a)
            black ^= 1
        if a >= columns:
            break
    return out


def decode(data: bytes, columns: int = 1728, rows: int = 0, k: int = 0, black_is_1: bool = False, byte_align: bool = False) -> tuple[bytes, bool]:
    """(rows of packed bits, 1 white unless black_is_1; whether all rows came). rows 0: as many as there are."""
    bits, lines, above, whole = _Bits(data), [], [], True
    try:
        while (not rows or len(lines) < rows) and bits.at < len(bits.s):
            if k >= 0:
                zero = bits.s.find("1", bits.at)
                if zero - bits.at >= 11:  # an end of line
                    bits.at = zero + 1
                    ends = 0
                    while bits.s.startswith("000000000001", bits.at + (k > 0)):
                        bits.at += 12 + (k > 0)
                        ends += 1
                    if ends >= 2:
                        break
            elif bits.s.startswith("000000000001" * 2, bits.at):
                break
            if byte_align and k < 0:
                bits.at = -(-bits.at // 8) * 8
            level = k == 0
            if k > 0:
                level = bits.s[bits.at : bits.at + 1] == "1"
                bits.at += 1
            if not rows and "1" not in bits.s[bits.at :]:
                break
            above = _level(bits, columns) if level else _against(bits, above, columns)
            lines.append(above)
            if byte_align and k >= 0:
                bits.at = -(-bits.at // 8) * 8
    except _Damaged:
        whole = False
    n = rows or len(lines)
    out = np.zeros((n, columns), np.uint8)
    for y, changes in enumerate(lines[:n]):
        for a, b in zip(changes[::2], [*changes[1::2], columns]):
            out[y, a:b] = 1
    return np.packbits(out if black_is_1 else 1 - out, axis=1).tobytes(), whole and len(lines) >= rows
