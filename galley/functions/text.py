"""Column functions on strings."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that XML 1.0 forbids.
XML_ILLEGAL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFE}\\x{FFFF}]"
# Characters that may stand in a URL as they are (RFC 3986), and the percent sign.
URL_LEGAL = "[A-Za-z0-9\\-._~:/?#\\[\\]@!$&'()*+,;=%]"
# Glyphs that mark list items, and the pattern of numbered markers.
BULLETS = "•◦▪‣·○●■–-*"
NUMBERED = "^(\\d{1,3}|[A-Za-z]|[ivxlcIVXLC]{1,5})[.)]$"
# Words before a total number of pages.
OF_WORDS = "(/|(^|[^\\p{L}])(of|de|von|sur))$"
# Blocks of scripts, as ranges of code points in a character class.
CJK = "[\\x{2E80}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FF00}-\\x{FFEF}]"
RTL = "[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"
# Advances (thousandths) of the printable ASCII characters in the standard sans-serif font.
HELVETICA = {
    191: "'", 222: "ijl", 260: "|", 278: " !,./:;I[\\]ft", 333: "()-`r", 334: "{}", 355: '"', 389: "*", 469: "^", 500: "Jcksvxyz", 556: "#$0123456789?L_abdeghnopqu", 584: "+<=>~", 611: "FTZ",
    667: "&ABEKPSVXY", 722: "CDHNRUw", 778: "GOQ", 833: "Mm", 889: "%", 944: "W", 1015: "@",
}
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def xml_safe(text: Column) -> Column:
    return F.regexp_replace(text, XML_ILLEGAL, "")


def percent_encoded(url: Column) -> Column:
    """url with its illegal characters as percent-encoded UTF-8 octets; an empty one is null."""
    octets = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    made = F.array_join(F.transform(F.split(url, ""), lambda c: F.when((c == "") | c.rlike(f"^{URL_LEGAL}$"), c).otherwise(octets(c))), "")
    return F.when(made != "", made)


def digits_masked(text: Column) -> Column:
    """Trimmed, with runs of digits of any script as #."""
    return F.regexp_replace(F.btrim(text), "\\p{Nd}+", "#")


def squeezed(text: Column, n: int = 60) -> Column:
    """The first n characters without white space."""
    return F.substring(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", ""), 1, n)


def is_marker(word: Column) -> Column:
    """Whether a word is a list marker: a bullet glyph, or a short number or letter with . or )."""
    return (F.length(word) == 1) & F.lit(BULLETS).contains(word) | word.rlike(NUMBERED)


def _thousandths(advances: dict[int, str], default: int | None) -> Callable[[Column], Column]:
    """The sum of the advances of ASCII characters as a function of a text; the first advance that has a character counts."""
    of = {c: advance for advance, chars in reversed(advances.items()) for c in chars}
    # What a byte adds: bytes that go on a character nothing, those that begin an unknown one the default, or the mark of a null.
    table = np.array([of.get(chr(b), default or 0) if b < 128 else 0 if b < 192 else default or 0 for b in range(256)], np.int64)
    unknown = np.array([default is None and (b >= 192 or b < 128 and chr(b) not in of) for b in range(256)])

    @F.arrow_udf("bigint")
    def total(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        own = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
        at = ends - ends[0]
        upto = np.r_[0, np.cumsum(table[own])]
        none = np.r_[0, np.cumsum(unknown[own])]
        null = (none[at[1:]] > none[at[:-1]]) | texts.is_null().to_numpy(zero_copy_only=False)
        return pa.array(upto[at[1:]] - upto[at[:-1]], mask=null)

    return total


def width(text: Column, advances: dict[int, str], size: Column, default: int | None = None) -> Column:
    """The sum of the characters' advances (thousandths) times size / 1000.

    advances has the characters of each advance, as they do in a font with few distinct ones; a character
    in none of them has the default, or makes the width null where there is none. Where all of them are ASCII, the
    bytes of a text are looked up in one pass.
    """
    if all(c.isascii() for chars in advances.values() for c in chars):
        total = _thousandths(advances, default)(text).cast("double")
        return total * size / 1000.0
    total, rest = F.lit(0.0), text
    for advance, chars in advances.items():
        left = F.translate(rest, chars, "")
        total, rest = total + (F.length(rest) - F.length(left)) * float(advance), left
    total = total + F.length(rest) * float(default) if default is not None else F.when(rest == "", total)
    return total * size / 1000.0


def soft_join(text: Column, following: Column) -> Column:
    """What a line adds before the next one: without its hyphen before a lower-case letter, else with a space unless it ends in a space or hyphen."""
    hyphenated = text.rlike("\\p{L}-$") & following.rlike("^\\p{Ll}")
    return F.when(following.isNull(), text).when(hyphenated, F.regexp_replace(text, "-$", "")).when(text.rlike("[ -]$"), text).otherwise(F.concat(text, F.lit(" ")))
