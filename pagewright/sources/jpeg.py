"""Baseline JPEG data (ITU-T T.81): Huffman-coded, 8 bits a sample. Other kinds (progressive, arithmetic, 12 bits) raise Unsupported.

Coefficients are read code by code; dequantising, the inverse transform and colours are numpy over all blocks at once.
Damaged entropy data leaves the rest of a picture grey.
"""

from __future__ import annotations

import numpy as np


class Unsupported(Exception):
    pass


def zigzag() -> np.ndarray:
    """The place (row by row) of each coefficient in coding order."""
    at = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * y + x for y, x in at])


_ZIGZAG = zigzag().tolist()
_K = np.arange(8)
_COS = np.cos((2 * _K[:, None] + 1) * _K[None] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.5), 1) / 2  # sample x coefficient


class _Table:
    """By the next 16 bits: the code's length and symbol; length 0 where there is none."""

    def __init__(self, counts: bytes, symbols: bytes):
        length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
        code = k = 0
        for n, many in enumerate(counts, 1):
            for _ in range(many):
                if k >= len(symbols) or code >> n:
                    raise Unsupported
                lo = code << (16 - n)
                length[lo : lo + (1 << (16 - n))], symbol[lo : lo + (1 << (16 - n))] = n, symbols[k]
                code, k = code + 1, k + 1
            code <<= 1
        self.length, self.symbol = length.tolist(), symbol.tolist()


class _Bits:
    def __init__(self, data: bytes):
        self.d, self.at, self.held, self.n = data, 0, 0, 0

    def _fill(self) -> None:
        chunk = self.d[self.at : self.at + 32]
        self.at += 32
        self.held = (self.held & ((1 << self.n) - 1)) << 256 | int.from_bytes(chunk.ljust(32, b"\0"), "big")
        self.n += 256

    def symbol(self, t: _Table) -> int:
        if self.n < 32:
            if self.at > len(self.d) + 64:
                raise EOFError
            self._fill()
        k = self.held >> (self.n - 16) & 0xFFFF
        n = t.length[k]
        if not n:
            raise EOFError
        self.n -= n
        return t.symbol[k]

    def value(self, size: int) -> int:
        """A signed value of so many bits."""
        if not size:
            return 0
        if self.n < 32:
            self._fill()
        self.n -= size
        v = self.held >> self.n & ((1 << size) - 1)
        return v if v >> (size - 1) else v - (1 << size) + 1


def _block(bits: _Bits, dc: _Table, ac: _Table, out: list[int]) -> int:
    """One block's coefficients into out; returns the difference of its first one."""
    first = bits.value(bits.symbol(dc))
    k = 1
    while k < 64:
        s = bits.symbol(ac)
        run, size = s >> 4, s & 15
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise EOFError
        out[_ZIGZAG[k]] = bits.value(size)
        k += 1
    return first


def decode(data: bytes) -> np.ndarray:
    """Samples (h, w, components): grey, RGB or CMYK, as the file's marks say."""
    at, tables, quant, every, adobe = 2, {}, {}, 0, None
    frame: list[dict] = []
    if data[:2] != b"\xff\xd8":
        raise Unsupported
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        part, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while part:
                wide = part[0] >> 4
                n = 64 * (1 + wide)
                quant[part[0] & 15] = np.frombuffer(part[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                part = part[1 + n :]
        elif mark == 0xC4:
            while part:
                n = sum(part[1:17])
                tables[part[0]] = _Table(part[1:17], part[17 : 17 + n])
                part = part[17 + n :]
        elif mark in (0xC0, 0xC1):
            if part[0] != 8:
                raise Unsupported
            h, w = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            frame = [{"id": part[k], "h": part[k + 1] >> 4, "v": part[k + 1] & 15, "q": part[k + 2]} for k in range(6, 6 + 3 * part[5], 3)]
            if not (h and w and len(frame) in (1, 3, 4) and all(1 <= c["h"] <= 4 and 1 <= c["v"] <= 4 for c in frame)):
                raise Unsupported
            if len(frame) == 1:
                frame[0]["h"] = frame[0]["v"] = 1
            top_h, top_v = max(c["h"] for c in frame), max(c["v"] for c in frame)
            mx, my = -(-w // (8 * top_h)), -(-h // (8 * top_v))
            for c in frame:
                c["blocks"] = np.zeros((my * c["v"], mx * c["h"], 64), np.int64)
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise Unsupported
        elif mark == 0xDD:
            every = int.from_bytes(part[:2], "big")
        elif mark == 0xEE and part[:5] == b"Adobe" and len(part) > 11:
            adobe = part[11]
        elif mark == 0xDA:
            if not frame:
                raise Unsupported
            end = at
            while (end := data.find(b"\xff", end)) >= 0 and end + 1 < len(data) and (data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7):
                end += 2
            end = len(data) if end < 0 else end
            _scan(data[at:end], part, frame, tables, every, w, h, mx, my)
            at = end
    if not frame:
        raise Unsupported
    return _picture(frame, quant, w, h, adobe)


def _scan(data: bytes, head: bytes, frame: list[dict], tables: dict, every: int, w: int, h: int, mx: int, my: int) -> None:
    of = []
    for k in range(head[0]):
        c = next((c for c in frame if c["id"] == head[1 + 2 * k]), None)
        t = head[2 + 2 * k]
        if c is None or (t >> 4) not in tables or (16 | t & 15) not in tables:
            raise Unsupported
        of.append((c, tables[t >> 4], tables[16 | t & 15]))
    parts, start, k = [], 0, 0
    while (k := data.find(b"\xff", k)) >= 0:  # restart marks part the data
        if k + 1 < len(data) and 0xD0 <= data[k + 1] <= 0xD7:
            parts.append(data[start:k])
            start = k + 2
        k += 2
    parts.append(data[start:])
    top_h, top_v = max(c["h"] for c in frame), max(c["v"] for c in frame)
    if len(of) == 1:  # a component by itself: its own blocks, row by row
        c = of[0][0]
        nx, ny = -(-(-(-w * c["h"] // top_h)) // 8), -(-(-(-h * c["v"] // top_v)) // 8)
    else:
        nx, ny = mx, my
    unit = 0
    for raw in parts:
        bits, before = _Bits(raw.replace(b"\xff\x00", b"\xff")), [0] * len(of)
        for unit in range(unit, min(nx * ny, unit + every) if every else nx * ny):
            y, x = divmod(unit, nx)
            try:
                for i, (c, dc, ac) in enumerate(of):
                    for v in range(c["v"] if len(of) > 1 else 1):
                        for u in range(c["h"] if len(of) > 1 else 1):
                            out = [0] * 64
                            before[i] += _block(bits, dc, ac, out)
                            out[0] = before[i]
                            by, bx = (y * c["v"] + v, x * c["h"] + u) if len(of) > 1 else (y, x)
                            c["blocks"][by, bx] = out
            except EOFError:
                break
        unit = (unit // every + 1) * every if every else nx * ny


def _picture(frame: list[dict], quant: dict, w: int, h: int, adobe: int | None) -> np.ndarray:
    top_h, top_v = max(c["h"] for c in frame), max(c["v"] for c in frame)
    planes = []
    for c in frame:
        if c["q"] not in quant or len(quant[c["q"]]) != 64:
            raise Unsupported
        q = np.zeros(64, np.int64)
        q[_ZIGZAG] = quant[c["q"]]
        b = (c["blocks"] * q).reshape(*c["blocks"].shape[:2], 8, 8)
        s = np.floor(np.einsum("yk,abkl,xl->abyx", _COS, b, _COS, optimize=True) + 128.5)
        s = np.clip(s, 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * b.shape[0], 8 * b.shape[1])
        ys, xs = np.arange(h) * c["v"] // top_v, np.arange(w) * c["h"] // top_h
        planes.append(s[np.ix_(ys, xs)])
    out = np.stack(planes, 2)
    if len(frame) == 3 and adobe != 0:
        return rgb_of(out)
    if len(frame) == 4 and adobe == 2:
        return np.concatenate([255 - rgb_of(out[..., :3]), out[..., 3:]], 2)
    return out


def rgb_of(ycc: np.ndarray) -> np.ndarray:
    """P20: luma and colour differences to RGB in 16-bit fixed point."""
    y, b, r = (ycc[..., k].astype(np.int64) for k in range(3))
    b, r, half = b - 128, r - 128, 1 << 15
    red, blue = y + ((91881 * r + half) >> 16), y + ((116130 * b + half) >> 16)
    green = y + ((-22554 * b - 46802 * r + half) >> 16)
    return np.clip(np.stack([red, green, blue], -1), 0, 255).astype(np.uint8)
