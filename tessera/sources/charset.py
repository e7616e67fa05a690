"""Which charset bytes are in: by their mark, by what is valid, and by how plausible the letters are.

A charset in which the bytes are not valid is out. What is left is judged by the characters that the
bytes would be: letters that follow one another as they do in writing count for it, signs in the midst of
words, letters that change case or script within a word, and rare code points against it. A text in
capitals alone may pass for small letters of another Cyrillic set, and a few letters say little.
"""

from __future__ import annotations

import codecs
import unicodedata
from collections import Counter
from functools import lru_cache

MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Tried in this order, and of equals the first wins.
WIDE = ("utf-16-le", "utf-16-be")
SEVERAL = ("shift_jis", "euc_jp", "gb18030", "big5", "euc_kr")
SINGLE = ("cp1252", "cp1251", "koi8-r", "cp1250", "cp1253", "cp1255", "cp1256", "iso8859-5", "iso8859-2", "mac_cyrillic", "cp866")
#: The letters that make up most of a language's text.
FREQUENT = set("оеаинтсрвлкмдпуяыьгзбчйжшюіїєґўђјљњћџ" "αοιετσνηυρπκμλςάέήίόύώ" "éèàêçôîâùûëïäöüßñóíáúãõåøæńłśżźćąęőűčřšžěůýťďňžğşı")
#: Pairs of letters that tell Russian text from the same bytes in another Cyrillic set.
PAIRS = set("ст но то на ен ов ни ра во ко по пр ро го ли ос ал ре ть ка ва ск не от ел мо об ет ол ло ор ла ри".split())


@lru_cache(maxsize=100_000)
def _kind(c: str) -> str:
    """Script and case of a character, or what else it is."""
    n = ord(c)
    if 0x3040 <= n < 0x30A0:
        return "kana"
    if 0x30A0 <= n < 0x3100 or n in (0x3001, 0x3002):
        return "katakana" if n >= 0x30A0 else "stop"
    if 0x4E00 <= n < 0xA000:
        return "common" if _common(c) else "han"
    if 0xAC00 <= n < 0xD7A4:
        return "hangul"
    category = unicodedata.category(c)
    if category in ("Cc", "Cn", "Co", "Cs"):
        return "bad"
    if 0xFF61 <= n < 0xFFA0 or 0x2500 <= n < 0x25A0:
        return "odd"
    if category in ("Lu", "Ll", "Lo"):
        script = unicodedata.name(c, "").split(" ")[0]
        return f"{script}{category}" if script in ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC") else "odd"
    return "mark" if category in ("Mn", "Mc") else "sign"


def _common(c: str) -> bool:
    """Whether a character is in the first level of a national set, which is ordered by use."""
    for name, last in (("gb2312", 0xD7), ("euc_jp", 0xCF), ("big5", 0xC6)):
        try:
            raw = c.encode(name)
        except UnicodeEncodeError:
            continue
        if len(raw) == 2 and (0xB0 if name != "big5" else 0xA4) <= raw[0] <= last:
            return True
    return False


WORTH = {"kana": 3.0, "katakana": 1.6, "stop": 2.0, "common": 2.0, "han": -1.0, "hangul": 2.6, "bad": -8.0, "odd": -3.0, "sign": -0.3, "mark": 0.3}


def plausible(text: str) -> float:
    """The worth of a text's characters beyond ASCII, on average."""
    total, count, before = 0.0, 0, " "
    pairs = Counter(zip(" " + text, text, strict=False))
    for (before, c), n in pairs.items():
        if c < "\x80":
            if not (c.isprintable() or c in "\t\n\r\f"):
                total -= 4.0 * n
            elif c.isalpha() and before > "\x7f" and _kind(before)[:-2] not in ("LATIN", ""):
                total -= 1.0 * n
            continue
        count += n
        kind = _kind(c)
        if kind in WORTH:
            worth = WORTH[kind]
            if kind == "sign" and before.isalpha():
                worth -= 0.7
        else:
            script, case = kind[:-2], kind[-2:]
            worth = 1.0 + 0.8 * (c.lower() in FREQUENT)
            earlier = _kind(before) if before > "\x7f" else ("LATINLl" if before.islower() else "LATINLu" if before.isupper() else "")
            if earlier[:-2] in ("LATIN", "CYRILLIC", "GREEK", "HEBREW", "ARABIC"):
                worth += 0.6 if earlier[:-2] == script else -2.5
                if case == "Lu":
                    worth -= 2.5 if earlier.endswith("Ll") else 0.8
                elif case == "Ll" and earlier == kind and script == "LATIN" and before > "\x7f":
                    worth -= 1.2  # accents seldom follow one another
            if script != "LATIN" and not before.isalpha():
                worth -= 2.2  # a letter of its own says little, the ones that follow it more
            worth += 0.8 * ((before + c).lower() in PAIRS)
            if case == "Lu":
                worth -= 0.6
        total += worth * n
    return total / count if count else total


def detect(data: bytes | None) -> str | None:
    """A codec's name; utf-8 for what is plain or empty, null for null."""
    if data is None:
        return None
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    zeros = data.count(0)
    try:
        data.decode("utf-8")
        if not zeros:
            return "iso2022_jp" if b"\x1b$" in data and _valid(data, "iso2022_jp") is not None else "utf-8"
    except UnicodeDecodeError:
        pass
    found = []
    if len(data) % 2 == 0 and (zeros or len(set(data[1::2])) * 4 < len(set(data[::2])) or len(set(data[::2])) * 4 < len(set(data[1::2]))):
        for name in WIDE:
            text = _valid(data, name)
            if text is not None and "\x00" not in text:
                ascii_ = sum(c < "\x80" for c in text)
                found.append((max(plausible(text), 0.0) + 3.0 * ascii_ / max(len(text), 1), name))
        if found:
            return max(found, key=lambda x: x[0])[1]
    for name in SEVERAL + SINGLE:
        text = _valid(data, name)
        if text is not None:
            found.append((plausible(text), name))
    return max(found, key=lambda x: x[0], default=(0.0, "iso8859-1"))[1]


def _valid(data: bytes, name: str) -> str | None:
    try:
        return data.decode(name)
    except (UnicodeDecodeError, ValueError):
        return None


def text(data: bytes | None) -> str | None:
    """The text of bytes in their charset, without a mark; what is not valid in it becomes replacement characters."""
    if data is None:
        return None
    return data.decode(detect(data), "replace").removeprefix("\ufeff").encode("utf-8", "replace").decode()
