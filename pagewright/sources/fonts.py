"""Fonts of a document: codes, widths, heights and text of the glyphs that a string shows (ISO 32000-1, 9.5 to 9.10).

Simple fonts have one byte a code, Type 0 fonts what their CMap says (two bytes for the predefined ones). Text comes
from ToUnicode, else from the glyph names of the encoding; a code with neither is unmapped. Widths come from the font,
else from the metrics of the standard fonts by character. Units are ems.
"""

from __future__ import annotations

import re
import unicodedata

# fixed values: widths of the characters from the blank to the tilde in thousandths, of two of the standard fonts
_WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 "
    "833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Times": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 "
    "889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
}
_WIDTHS = {k: dict(zip(map(chr, range(32, 127)), map(int, v.split()))) for k, v in _WIDTHS.items()}
#: fixed values: (descent, ascent) of standard fonts
_HEIGHTS = {"Courier": (-157, 629), "Helvetica": (-207, 718), "Times": (-217, 683)}
#: fixed values: glyph names of characters whose Unicode names don't give them
_SIGNS = dict(
    x.split(":")
    for x in (
        "space:0020 exclam:0021 quotedbl:0022 numbersign:0023 dollar:0024 percent:0025 ampersand:0026 quotesingle:0027 parenleft:0028 parenright:0029 asterisk:002A plus:002B comma:002C hyphen:002D period:002E slash:002F "
        "colon:003A semicolon:003B less:003C equal:003D greater:003E question:003F at:0040 bracketleft:005B backslash:005C bracketright:005D asciicircum:005E underscore:005F grave:0060 braceleft:007B bar:007C braceright:007D asciitilde:007E "
        "exclamdown:00A1 cent:00A2 sterling:00A3 currency:00A4 yen:00A5 brokenbar:00A6 section:00A7 dieresis:00A8 copyright:00A9 ordfeminine:00AA guillemotleft:00AB logicalnot:00AC registered:00AE macron:00AF degree:00B0 plusminus:00B1 "
        "acute:00B4 mu:00B5 paragraph:00B6 periodcentered:00B7 cedilla:00B8 ordmasculine:00BA guillemotright:00BB onequarter:00BC onehalf:00BD threequarters:00BE questiondown:00BF multiply:00D7 divide:00F7 germandbls:00DF "
        "ae:00E6 AE:00C6 oe:0153 OE:0152 oslash:00F8 Oslash:00D8 eth:00F0 Eth:00D0 thorn:00FE Thorn:00DE dotlessi:0131 lslash:0142 Lslash:0141 florin:0192 circumflex:02C6 caron:02C7 breve:02D8 dotaccent:02D9 ring:02DA ogonek:02DB tilde:02DC "
        "endash:2013 emdash:2014 quoteleft:2018 quoteright:2019 quotesinglbase:201A quotedblleft:201C quotedblright:201D quotedblbase:201E dagger:2020 daggerdbl:2021 bullet:2022 ellipsis:2026 perthousand:2030 guilsinglleft:2039 "
        "guilsinglright:203A fraction:2044 Euro:20AC trademark:2122 minus:2212 fi:FB01 fl:FB02 ff:FB00 ffi:FB03 ffl:FB04"
    ).split()
)
_ACCENTS = {"ACUTE": "acute", "GRAVE": "grave", "CIRCUMFLEX": "circumflex", "DIAERESIS": "dieresis", "TILDE": "tilde", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "MACRON": "macron", "BREVE": "breve", "OGONEK": "ogonek"}


def _glyph_names() -> dict[str, str]:
    out = {k: chr(int(v, 16)) for k, v in _SIGNS.items()}
    for c in map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0x180)]):
        name = unicodedata.name(c)
        if name.startswith("DIGIT "):
            out[name[6:].lower()] = c
        elif m := re.fullmatch(r"LATIN (SMALL|CAPITAL) LETTER ([A-Z])(?: WITH (.+))?", name):
            letter = m[2].lower() if m[1] == "SMALL" else m[2]
            if not m[3] or m[3] in _ACCENTS:
                out[letter + _ACCENTS.get(m[3], "")] = c
    return out


GLYPHS = _glyph_names()


def text_of_glyph(name: str) -> str | None:
    """The text of a glyph name; None if it says nothing."""
    name = name.split(".")[0]
    if name in GLYPHS:
        return GLYPHS[name]
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", name):
        try:
            return "".join(chr(int(h, 16)) for h in (re.findall("....", m[1]) if m[1] else [m[2]]))
        except ValueError:
            return None
    return "".join(map(text_of_glyph, name.split("_"))) if "_" in name and all(text_of_glyph(x) for x in name.split("_")) else None


def _standard() -> dict[int, str]:
    out = {k: chr(k) for k in range(32, 127)} | {39: "’", 96: "‘"}
    upper = "161:¡ 162:¢ 163:£ 164:⁄ 165:¥ 166:ƒ 167:§ 168:¤ 169:' 170:“ 171:« 172:‹ 173:› 174:ﬁ 175:ﬂ 177:– 178:† 179:‡ 180:· 182:¶ 183:• 184:‚ 185:„ 186:” 187:» 188:… 189:‰ 191:¿ 193:` 194:´ 195:ˆ 196:˜ 197:¯ 198:˘ 199:˙ 200:¨ 202:˚ 203:¸ 205:˝ 206:˛ 207:ˇ 208:— 225:Æ 227:ª 232:Ł 233:Ø 234:Œ 235:º 241:æ 245:ı 248:ł 249:ø 250:œ 251:ß"
    return out | {int(x.split(":", 1)[0]): x.split(":", 1)[1] for x in upper.split(" ")}


def _codec(name: str) -> dict[int, str]:
    out = {}
    for k in range(32, 256):
        try:
            out[k] = bytes([k]).decode(name)
        except UnicodeDecodeError:
            pass
    return out


ENCODINGS = {"WinAnsiEncoding": _codec("cp1252"), "MacRomanEncoding": _codec("mac_roman"), "StandardEncoding": _standard()}


class CMap:
    """Code lengths and targets of a CMap stream: text (bfchar, bfrange) and CIDs (cidchar, cidrange)."""

    MOST = 1 << 16  # codes of one range that are taken apart

    def __init__(self, data: bytes, lexer):
        self.text: dict[int, str] = {}
        self.cid: dict[int, int] = {}
        self.ranges: list[tuple[int, int, int]] = []  # (low, high, length) of codes
        lex, st, mode = lexer(data), [], b""
        while (x := lex.next()) is not None:
            if type(x).__name__ != "Op":
                st.append(x)
                continue
            op = bytes(x)
            if op.startswith(b"begin"):
                mode, st = op[5:], []
            elif op.startswith(b"end") and op[3:] == mode:
                self._take(mode, st)
                mode, st = b"", []

    def _take(self, mode: bytes, st: list) -> None:
        num = lambda b: int.from_bytes(b, "big")
        text = lambda b: b.decode("utf-16-be", "replace")
        if mode == b"codespacerange":
            self.ranges += [(num(a), num(b), len(a)) for a, b in zip(st[::2], st[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
        elif mode == b"bfchar":
            self.text |= {num(a): text(b) for a, b in zip(st[::2], st[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif mode == b"cidchar":
            self.cid |= {num(a): b for a, b in zip(st[::2], st[1::2]) if isinstance(a, bytes) and isinstance(b, int)}
        elif mode in (b"bfrange", b"cidrange"):
            for a, b, c in zip(st[::3], st[1::3], st[2::3]):
                if not (isinstance(a, bytes) and isinstance(b, bytes)):
                    continue
                lo, hi = num(a), min(num(b), num(a) + self.MOST)
                if mode == b"cidrange" and isinstance(c, int):
                    self.cid |= {k: c + k - lo for k in range(lo, hi + 1)}
                elif isinstance(c, list):
                    self.text |= {lo + k: text(v) for k, v in enumerate(c) if isinstance(v, bytes)}
                elif isinstance(c, bytes) and c:
                    head, last = c[:-2], num(c[-2:])
                    self.text |= {k: text(head + min(0xFFFF, last + k - lo).to_bytes(min(2, len(c)), "big")) for k in range(lo, hi + 1) if min(2, len(c)) == 2 or last + k - lo < 256}


class Font:
    """One font dictionary; `get` and `decode` are the document's."""

    def __init__(self, d: dict, doc, lexer):
        get = doc.get
        self.get, self.doc, self.lexer = get, doc, lexer
        self.base, self.kind = str(get(d.get("BaseFont")) or ""), str(get(d.get("Subtype")) or "")
        self.composite = self.kind == "Type0"
        kids = get(d.get("DescendantFonts"))
        inner = get(kids[0]) if self.composite and isinstance(kids, list) and kids else d
        inner = inner if isinstance(inner, dict) else {}
        desc = get(inner.get("FontDescriptor"))
        desc = desc if isinstance(desc, dict) else {}
        self.embedded = any(k in desc for k in ("FontFile", "FontFile2", "FontFile3"))
        stream = get(d.get("ToUnicode"))
        self.to_unicode = CMap(doc.decode(stream), lexer) if hasattr(stream, "raw") else None
        self.matrix = 0.001
        self.boxes: dict[int, tuple | None] = {}
        self._encoding(d, get)
        self._widths(d, inner, desc, get)
        self._heights(desc, get)
        self.procs = get(d.get("CharProcs")) if self.kind == "Type3" else None
        if self.kind == "Type3":
            m = get(d.get("FontMatrix"))
            self.matrix = float(m[0]) if isinstance(m, list) and m and isinstance(m[0], (int, float)) and m[0] else 0.001

    def family(self) -> str:
        return "Courier" if "Courier" in self.base else "Times" if "Times" in self.base else "Helvetica"

    def _encoding(self, d: dict, get) -> None:
        e = get(d.get("Encoding"))
        self.names: dict[int, str] = {}
        self.cmap = CMap(self.doc.decode(e), self.lexer) if self.composite and hasattr(e, "raw") else None
        base = e if isinstance(e, str) else get(e.get("BaseEncoding")) if isinstance(e, dict) else None
        self.encoding = str(base or ("custom" if e else ""))
        plain = "WinAnsiEncoding" if self.kind == "TrueType" else "StandardEncoding"
        own = self.base.split("+")[-1] in ("Symbol", "ZapfDingbats") or self.kind == "Type3"
        self.table = {} if self.composite or (own and base not in ENCODINGS) else dict(ENCODINGS.get(base, ENCODINGS[plain]))
        diff = get(e.get("Differences")) if isinstance(e, dict) else None
        code = 0
        for x in diff if isinstance(diff, list) else []:
            x = get(x)
            if isinstance(x, int):
                code = x
            elif isinstance(x, str):
                self.names[code] = str(x)
                code += 1

    def _widths(self, d: dict, inner: dict, desc: dict, get) -> None:
        number = lambda x, other: x if isinstance((x := get(x)), (int, float)) and not isinstance(x, bool) else other
        self.width: dict[int, float] = {}
        if self.composite:
            self.default, self.source = number(inner.get("DW"), 1000), "W"
            w, k = get(inner.get("W")), 0
            w = [get(x) for x in w] if isinstance(w, list) else []
            while k + 1 < len(w):
                if isinstance(w[k + 1], list):
                    self.width |= {w[k] + i: number(x, 0) for i, x in enumerate(w[k + 1])}
                    k += 2
                elif k + 2 < len(w) and isinstance(w[k], int) and isinstance(w[k + 1], int):
                    self.width |= dict.fromkeys(range(w[k], min(w[k + 1], w[k] + CMap.MOST) + 1), number(w[k + 2], 0))
                    k += 3
                else:
                    break
            return
        widths, first = get(d.get("Widths")), number(d.get("FirstChar"), 0)
        self.source = "Widths" if isinstance(widths, list) else "standard"
        if isinstance(widths, list):
            self.width = {int(first) + k: number(x, 0) for k, x in enumerate(widths)}
            self.default = number(desc.get("MissingWidth"), 0)
        else:
            self.default = None

    def _heights(self, desc: dict, get) -> None:
        number = lambda k: x if isinstance((x := get(desc.get(k))), (int, float)) and not isinstance(x, bool) else None
        low, high = _HEIGHTS[self.family()]
        box = get(desc.get("FontBBox"))
        box = [get(x) for x in box] if isinstance(box, list) and len(box) == 4 else [0, low, 0, high]
        asc, de = number("Ascent"), number("Descent")
        asc, de = high if asc is None else asc or box[3], low if de is None else de or box[1]
        self.vertical = (-abs(de) / 1000, asc / 1000)

    def codes(self, s: bytes) -> list[tuple[int, int]]:
        """(code, its bytes) one after another."""
        if not self.composite:
            return [(c, 1) for c in s]
        ranges = self.cmap.ranges if self.cmap and self.cmap.ranges else [(0, 0xFFFF, 2)]
        out, a, least = [], 0, min(n for _, _, n in ranges)
        sizes = sorted({n for _, _, n in ranges})
        while a < len(s):
            for n in sizes:
                v = int.from_bytes(s[a : a + n], "big")
                if a + n <= len(s) and any(m == n and lo <= v <= hi for lo, hi, m in ranges):
                    break
            else:
                n, v = least, int.from_bytes(s[a : a + least], "big")
            out.append((v, n))
            a += n
        return out

    def advance(self, code: int) -> float:
        if self.composite:
            cid = self.cmap.cid.get(code, code) if self.cmap else code
            return self.width.get(cid, self.default) / 1000
        if self.default is not None:
            return self.width.get(code, self.default) * (self.matrix if self.kind == "Type3" else 0.001)
        if self.family() == "Courier":
            return 0.6
        t = (text_of_glyph(self.names[code]) if code in self.names else None) or self.table.get(code) or self.unicode(code) or ""
        t = unicodedata.normalize("NFD", t)[:1]
        return _WIDTHS[self.family()].get(t, 556 if self.family() == "Helvetica" else 500) / 1000

    def unicode(self, code: int) -> str | None:
        if self.to_unicode and (t := self.to_unicode.text.get(code)) is not None:
            return t
        if code in self.names:
            return text_of_glyph(self.names[code])
        return self.table.get(code)

    def glyph_box(self, code: int) -> tuple[float, float, float, float] | None:
        """The box that a Type 3 glyph says it paints in, in ems."""
        if not isinstance(self.procs, dict):
            return None
        if code not in self.boxes:
            s = self.get(self.procs.get(self.names.get(code)))
            m = re.search(rb"((?:[-+.\d]+\s+){6})d1\b", self.doc.decode(s)[:4096]) if hasattr(s, "raw") else None
            try:
                v = [float(x) * self.matrix for x in m[1].split()[2:]] if m else None
            except ValueError:
                v = None
            self.boxes[code] = tuple(v) if v else None
        return self.boxes[code]

    def info(self) -> dict:
        return {"base": self.base, "kind": self.kind, "encoding": self.encoding, "to_unicode": self.to_unicode is not None, "embedded": self.embedded, "widths": self.source}
