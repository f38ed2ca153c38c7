"""Label, token and text normalisation."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import NUMBER, col, trimmed

# Special tokens of the production survey and their flags.
SPECIAL_TOKENS = {
    "-": "SIDRA_ABSOLUTE_ZERO",
    "0": "SIDRA_ROUNDED_ZERO",
    "X": "SIDRA_SUPPRESSED",
    "..": "SIDRA_NOT_APPLICABLE",
    "...": "SIDRA_NOT_AVAILABLE",
}
ZERO_TOKENS = ("-", "0")
RANGE_FLAG = "SIDRA_VALUE_RANGE_OR_SUPPRESSED"
# Fixed value: "Name (UF)" or "Name - UF".
LABEL = r"^(.+?)(?: \(([A-Z]{2})\)| - ([A-Z]{2}))$"


def survey_number(raw: Column | str) -> Column:
    """``struct(value, flag, known)`` of one survey token; ``known`` is false for junk."""
    token = trimmed(raw)
    flag = F.lit(None).cast("string")
    for symbol, name in SPECIAL_TOKENS.items():
        flag = F.when(token == symbol, F.lit(name)).otherwise(flag)
    special = token.isin(*SPECIAL_TOKENS)
    letter = ~special & token.rlike(r"^\p{L}$")
    number = ~special & token.rlike(NUMBER)
    value = F.when(token.isin(*ZERO_TOKENS), F.lit(0.0)).when(number, token.try_cast("double"))
    return F.struct(
        value.alias("value"),
        F.when(letter, F.lit(RANGE_FLAG)).otherwise(flag).alias("flag"),
        F.coalesce(special | letter | number, F.lit(False)).alias("known"),
    )


def split_label(label: Column | str) -> Column:
    """``struct(municipio, uf)``; both NULL when the label has neither form."""
    text = trimmed(label)
    part = lambda i: F.nullif(F.regexp_extract(text, LABEL, i), F.lit(""))
    return F.struct(part(1).alias("municipio"), F.coalesce(part(2), part(3)).alias("uf"))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Characters to translate, their replacements, and those that expand to several.

    Rule: compatibility-decompose, drop combining marks, case-fold; keep what turns into ASCII
    letters or digits, and drop the marks themselves.
    """
    keep, onto, dropped, expand = [], [], [], {}
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        changes = unicodedata.decomposition(ch) or unicodedata.combining(ch)
        if 0xD800 <= point <= 0xDFFF or not (changes or ch.casefold().isascii()):
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        folded = bare.casefold()
        if not folded:
            dropped.append(ch)
        elif re.search("[a-z0-9]", folded):
            plain = re.sub("[^a-z0-9]+", " ", folded)
            if len(plain) == 1:
                keep.append(ch)
                onto.append(plain)
            else:
                expand[ch] = plain
    return "".join(keep + dropped), "".join(onto), expand


def normalise_text(c: Column | str) -> Column:
    """Accents and case folded, every run of other characters one space, ends trimmed."""
    source, target, expand = _folding()
    text = F.translate(col(c), source, target)
    pairs = "\x01".join(f"{ch}\x02{plain}" for ch, plain in expand.items())
    several = F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02"))  # folded to one constant
    expanded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(ch <= "\x7f", ch).otherwise(F.coalesce(F.try_element_at(several, ch), ch)),
        ),
        "",
    )
    # Dropping those characters changes only texts that hold one; a pattern of them all is slow.
    rare = F.translate(text, "".join(expand), "") != text
    text = F.lower(F.when(rare, expanded).otherwise(text))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def normalise_label(value: str) -> str:
    """The same rule for one configuration label on the driver."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))
    return " ".join(re.sub("[^a-z0-9]+", " ", bare.casefold()).split())


def ascii_upper(c: Column | str) -> Column:
    """Upper-case without accents, for the header lines of Latin-1 station files."""
    letters = [chr(p) for p in range(0xC0, 0x180)]
    pairs = [(ch, unicodedata.normalize("NFKD", ch)[0]) for ch in letters]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    plain = F.translate(col(c), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    text = F.upper(plain)
    for damaged, right in (("ESTAC?O", "ESTACAO"), ("REGI?O", "REGIAO")):
        text = F.replace(text, F.lit(damaged), F.lit(right))
    return text
