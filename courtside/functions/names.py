"""Names of people: normal form, last name, and whether two spellings agree."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: generation suffixes
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
#: fixed values: Hangul syllables are code points in order of lead, vowel and tail
HANGUL, LEADS, VOWELS, TAILS = 0xAC00, [0x1100 + i for i in range(19)], [0x1161 + i for i in range(21)], [0x11A8 + i for i in range(27)]


@functools.cache
def _decomposition() -> tuple[str, str, dict[str, str]]:
    """What compatibility decomposition without combining marks makes of single characters.

    (characters of one base letter and then those of none, the letters of the former, characters of several letters).
    Decomposing is done a character at a time, since only marks, which go, are ever reordered. Hangul is a formula.
    """
    one, none, several = {}, [], {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        if not unicodedata.decomposition(c) and not unicodedata.combining(c) or HANGUL <= ord(c) < HANGUL + 11_172:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not base:
            none.append(c)
        elif len(base) > 1:
            several[c] = base
        elif base != c:
            one[c] = base
    return "".join(one) + "".join(none), "".join(one.values()), several


def _hangul(c: Column) -> Column:
    """The two or three parts of a Hangul syllable; null for any other character."""
    s = F.ascii(c) - HANGUL
    part = lambda codes, at: F.substr(F.lit("".join(map(chr, codes))), (at + 1).cast("int"), F.lit(1))
    tail = F.when(s % 28 > 0, part(TAILS, s % 28 - 1)).otherwise("")
    return F.when((s >= 0) & (s < 11_172), F.concat(part(LEADS, F.floor(s / 588)), part(VOWELS, F.floor(s % 588 / 28)), tail))


@functools.cache
def _pages() -> tuple[list[int], str]:
    """The characters of several letters by code point, so that a look-up costs the same however many there are.

    (for each 256 code points the number of their page, 0 if they have none; the letters of all pages' 256 code points,
    empty for those that are not among them, page 0 being empty).
    """
    several = {ord(c): base for c, base in _decomposition()[2].items()}
    used = sorted({p >> 8 for p in several})
    number = {p: k + 1 for k, p in enumerate(used)}
    pages = [number.get(p, 0) for p in range(used[-1] + 1)]
    return pages, "\x01".join([""] * 256 + [several.get(p * 256 + k, "") for p in used for k in range(256)])


def _letters(c: Column) -> Column:
    """The letters of a character of several; null for any other one."""
    pages, letters = _pages()
    page = F.coalesce(F.get(F.array(*map(F.lit, pages)), F.shiftright(F.ascii(c), 8)), F.lit(0))
    return F.nullif(F.get(F.split(F.lit(letters), "\x01"), page * 256 + F.ascii(c) % 256), F.lit(""))  # both arrays are constants


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition (NFKD) without combining marks, in the JVM: one ``translate``, and a look-up of each
    character only in texts that have one which becomes several letters."""
    given, letters, several = _decomposition()
    # found by translate, which hashes: a class of so many characters is tried one by one
    rare = (F.translate(c, "".join(several), "") != c) | c.rlike(f"[{chr(HANGUL)}-{chr(HANGUL + 11_171)}]")
    apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(_letters(x), _hangul(x), x)), "")
    plain = F.translate(F.when(rare, apart).otherwise(c), given, letters)
    return F.when(c.rlike(r"[^\x00-\x7F]"), plain).otherwise(c)


def _tokens(c: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")


def normalize_name(c) -> Column:
    """Without accents, punctuation, case and suffix tokens; single blanks. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.filter(_tokens(strip_accents(c)), lambda w: ~w.isin(*SUFFIXES)), " ")


def normalize_ascii(c) -> Column:
    """``normalize_name`` for names known to be ASCII: no Python at all."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.filter(_tokens(c), lambda w: ~w.isin(*SUFFIXES)), " ")


def last_name(c) -> Column:
    """Last token in lower case, trailing suffixes left aside while another token remains."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: w != "")
    bare = F.filter(parts, lambda w, i: (i == 0) | ~F.regexp_replace(w, r"\.+$", "").isin(*SUFFIXES) | F.exists(F.slice(parts, i + 2, F.greatest(F.size(parts), F.lit(1))), lambda later: ~F.regexp_replace(later, r"\.+$", "").isin(*SUFFIXES)))
    return F.element_at(bare, -1)


def names_consistent(description, player) -> Column:
    """All words of the player's name (one at least) occur in the description's."""
    d, p = F.split(normalize_name(description), " "), F.filter(F.split(normalize_name(player), " "), lambda w: w != "")
    return F.coalesce((F.size(p) > 0) & (F.size(F.array_except(p, d)) == 0), F.lit(False))
