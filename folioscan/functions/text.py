"""Text as column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.limits import LIMITS

#: Ligatures U+FB00 to U+FB06.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}

#: Bytes of the standard document encoding that differ from Latin-1.
DOC_ENCODING = {
    0x18: "˘", 0x19: "ˇ", 0x1A: "ˆ", 0x1B: "˙", 0x1C: "˝", 0x1D: "˛", 0x1E: "˚", 0x1F: "˜",
    0x80: "•", 0x81: "†", 0x82: "‡", 0x83: "…", 0x84: "—", 0x85: "–", 0x86: "ƒ", 0x87: "⁄",
    0x88: "‹", 0x89: "›", 0x8A: "−", 0x8B: "‰", 0x8C: "„", 0x8D: "“", 0x8E: "”", 0x8F: "‘",
    0x90: "’", 0x91: "‚", 0x92: "™", 0x93: "ﬁ", 0x94: "ﬂ", 0x95: "Ł", 0x96: "Œ", 0x97: "Š",
    0x98: "Ÿ", 0x99: "Ž", 0x9A: "ı", 0x9B: "ł", 0x9C: "œ", 0x9D: "š", 0x9E: "ž", 0x9F: "�",
    0xA0: "€", 0xAD: "�",
}

#: Bidirectional and invisible formatting characters.
UNSAFE = r"\x{061C}\x{180E}\x{200B}-\x{200F}\x{2028}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{FFF9}-\x{FFFB}"


def haystack(text: Column) -> Column:
    """Runs of white space become one space; a leading run goes, a trailing one stays as a space."""
    return F.ltrim(F.regexp_replace(text, r"(?U)\s+", " "))


def ligatures_expanded(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return text


def text_only(text: Column) -> Column:
    """Without control characters other than tab and line ends."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n\r]]", "")


def printable(text: Column) -> Column:
    """Line ends become LF, other controls but tab become spaces."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lines, r"[\p{Cc}&&[^\t\n]]", " ")


def one_line(text: Column) -> Column:
    """Controls and invisible formatting become spaces."""
    return F.regexp_replace(text, r"[\p{Cc}" + UNSAFE + "]", " ")


def comparable(text: Column, most: int | None = LIMITS.compare_chars) -> Column:
    """Ligatures expanded; white space, controls, soft hyphens, zero-width spaces and replacement characters gone; cut, unless ``most`` is None."""
    bare = F.regexp_replace(ligatures_expanded(text), r"(?U)[\s\p{Cc}\x{00AD}\x{200B}\x{FFFD}]+", "")
    return bare if most is None else F.substring(bare, 1, most)


def truncated(text: Column, most: int = LIMITS.item_chars) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def utf16(raw: Column, big_endian: bool) -> Column:
    """Text of UTF-16 bytes; lone surrogates become U+FFFD, a last odd byte is dropped."""
    units = F.regexp_replace(F.hex(raw), "(..)(..)", "$1$2 " if big_endian else "$2$1 ")
    units = F.regexp_replace(units, "(?<= |^)..$", "")
    units = F.regexp_replace(units, "(D[89AB].. )(?!D[C-F])", "FFFD ")
    units = F.regexp_replace(units, "(?<!D[89AB].. )D[C-F].. ", "FFFD ")
    return F.decode(F.unhex(F.replace(units, F.lit(" "), F.lit(""))), "UTF-16BE")


def decoded(raw: Column) -> Column:
    """Text of bytes with a byte order mark, else in the standard document encoding; controls become spaces.  Malformed bytes become U+FFFD."""
    mark2, mark3 = F.hex(F.substring(raw, 1, 2)), F.hex(F.substring(raw, 1, 3))
    rest = lambda n: F.substring(raw, n + 1, 2**31 - 1)
    latin = F.translate(F.decode(raw, "ISO-8859-1"), "".join(map(chr, DOC_ENCODING)), "".join(DOC_ENCODING.values()))
    text = F.when(mark2 == "FEFF", utf16(rest(2), True)).when(mark2 == "FFFE", utf16(rest(2), False)).when(mark3 == "EFBBBF", F.make_valid_utf8(rest(3).cast("string"))).otherwise(latin)
    return F.regexp_replace(text, r"\p{Cc}", " ")


#: Roman digits of units, tens, hundreds and thousands.
ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm"),
)


def roman(n: Column) -> Column:
    """1 to 3999 in small roman digits, else the decimal number."""
    digit = lambda place: F.get(F.array(*map(F.lit, ROMAN[place])), (F.floor(n / 10**place) % 10).cast("int"))
    return F.when(n.between(1, 3999), F.concat(digit(3), digit(2), digit(1), digit(0))).otherwise(n.cast("string"))


def roman_value(text: Column) -> Column:
    """The number of canonical roman digits in either case, else null."""
    small = F.lower(text)
    value = F.lit(0).cast("long")
    pattern = "^(m{0,3})(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
    for place, group in ((3, 1), (2, 2), (1, 3), (0, 4)):
        part = F.regexp_extract(small, pattern, group)
        value = value + (F.array_position(F.array(*map(F.lit, ROMAN[place])), part) - 1) * 10**place
    return F.when(small.rlike(pattern) & (text != ""), value)


def letters(n: Column, most: int = LIMITS.label_repeats) -> Column:
    """a to z, aa to zz and so on; beyond ``most`` repetitions, and below 1, the decimal number."""
    times = F.floor((n - 1) / 26).cast("int") + 1
    return F.when((n >= 1) & (times <= most), F.repeat(F.char(97 + F.pmod(n - 1, F.lit(26))), times)).otherwise(n.cast("string"))


def label_number(style: Column, n: Column) -> Column:
    """A page number in a label style: D, R, r, A, a, or null for none."""
    return (
        F.when(style == "D", n.cast("string")).when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "a", letters(n)).when(style == "A", F.upper(letters(n))).otherwise(F.lit(""))
    )


LEVELS = ("ERROR", "WARN", "INFO", "DEBUG", "TRACE")


def cleaned_line(line: Column, most: int = LIMITS.line_bytes) -> Column:
    """Text or bytes cut to so many bytes; what is no UTF-8 then becomes U+FFFD, controls but tab become ``?``."""
    cut = F.make_valid_utf8(F.substring(line.cast("binary"), 1, most).cast("string"))
    return F.regexp_replace(cut, r"[\p{Cc}&&[^\t]]", "?")


def level_of(line: Column) -> Column:
    """The first level word among the first three tokens, else INFO."""
    tokens = F.slice(F.split(F.trim(line), r"\s+"), 1, 3)
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.isin(*LEVELS)), F.lit(0)), F.lit("INFO"))
