"""Unicode, script and clean-up functions over string columns."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Ligatures and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
# Punctuation signs and what they are read as.
PUNCTUATION = {
    "\u2550": "=", "\u201F": '"', "\u2E17": "\u2014", "\u25CF": "\u2022", "\u27E8": "\u3008", "\u27E9": "\u3009", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2015": "-",
    "\u2025": "..", "\u2026": "...", "\u2027": "\u00B7", "\u2032": "'", "\u2033": '"', "\uFF08": "(", "\uFF09": ")", "\u0375": ",", "\u02B9": "'", "\u02BA": '"',
    "\u02BB": "'", "\u02BC": "'", "\u02BD": "'", "\u02C8": "'", "\u02CA": "'", "\u02CB": "'", "\u02CC": ",", "\x92": "'",
}
# Control signs of old code pages.
NON_PRINTABLE = {**{chr(i): "" for i in range(9)}, "\x92": "'", "\x9e": "ï", "\x8e": "ï", "\x81": "ï", "\xad": "-"}
# Other signs and what they are read as; the squared capitals by rule.
SYMBOLS = {
    "\x9e": "ï", "\x8e": "ï", "\x81": "ï", "\xad": "-", "\u2053": "~", "\u223C": "~", "\u27B3": "\u2192", "\u21D2": "\u2192", "\u21D4": "\u2194", "\u21D0": "\u2190", "\u27A4": "\u2192",
    "\u02D6": "+", "\u02BC": "'", "\u00D7": "x", "\u201F": '"', "\u201B": "'", "\u03F0": "κ", "\u03F1": "ρ", "\u03D1": "θ", "\uA759": "q", "\uA75B": "r", "\uA758": "Q", "\uA75A": "R",
    "\uA753": "p", "\uA750": "P", **{chr(0x1F130 + i): chr(65 + i) for i in range(26)}, "\u2E22": "[", "\u2E23": "]", "\u2E24": "[", "\u230B": "]", "\u2308": "[", "\u2E25": "]",
    "\u2044": "/", "\u00B5": "\u03BC",
}
# Raised and lowered signs and their base signs.
SUPERSCRIPTS = dict(zip("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿªᵃᵅᵇᵝᶜᵈᵉᶠᵍⁱᵏᵐᵒᵖᵗᵘᵛ", "0123456789+-=()naaabbcdefgikmoptuv"))
SUBSCRIPTS = dict(zip("₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₒᵢⱼₖₗₘₙₚᵣₛₜᵤᵥₓ", "0123456789+-=()aeoijklmnprstuvx"))

# The ranges of each charset, first and last sign. Spaces count as punctuation.
CHARSET_RANGES = {
    "latin": ("AZ", "az", "\u00C0\u00FF", "\u0152\u0152", "\u0153\u0153"),
    "greek": (
        "\u0386\u038A", "\u038C\u038C", "\u038E\u03A1", "\u03A3\u03E1", "\u1F00\u1F15", "\u1F18\u1F1D", "\u1F20\u1F45", "\u1F48\u1F4D", "\u1F50\u1F57", "\u1F59\u1F59",
        "\u1F5B\u1F5B", "\u1F5D\u1F5D", "\u1F5F\u1F7D", "\u1F80\u1FB4", "\u1FB6\u1FBC", "\u1FBE\u1FBE", "\u1FC2\u1FC4", "\u1FC6\u1FCC", "\u1FD0\u1FD3", "\u1FD6\u1FDB",
        "\u1FE0\u1FEC", "\u1FF2\u1FF4", "\u1FF6\u1FFC", "\u2126\u2126", "\u0300\u0300", "\u0301\u0301", "\u0313\u0313", "\u0314\u0314", "\u0345\u0345", "\u0342\u0342",
        "\u0308\u0308", "\u00B7\u00B7", "\u0384\u0384",
    ),
    "numeral": ("09",),
    "punctuation": ("\u0020\u002F", "\u003A\u003F", "\u005B\u0060", "\u007B\u007E", "\u00A8\u00A8", "\u00B7\u00B7"),
}


def char_class(ranges) -> str:
    """The inside of a regular-expression class."""
    return "".join(rf"\u{ord(a):04X}-\u{ord(b):04X}" for a, b in ranges)


def chars_of(ranges) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(ord(a), ord(b) + 1))


CHARSETS = {name: char_class(ranges) for name, ranges in CHARSET_RANGES.items()}
#: The same charsets for decomposed texts: all signs that their members decompose into.
CHARSETS_NFD = {name: char_class(sorted((c, c) for c in set(unicodedata.normalize("NFD", chars_of(ranges))))) for name, ranges in CHARSET_RANGES.items()}
URL = r"https?://\S+|www\.\S+"
EMAIL = r"[a-zA-Z09._-]+@[a-zA-Z09._-]+\.[a-zA-Z]+"


def substitute(text: Column, table: dict[str, str]) -> Column:
    """One-to-one signs by one translate, the others by replace."""
    single = {k: v for k, v in table.items() if len(v) <= 1 and len(k) == 1}
    kept = {k: v for k, v in single.items() if v}
    gone = [k for k, v in single.items() if not v]
    text = F.translate(text, "".join(kept) + "".join(gone), "".join(kept.values())) if single else text
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in table.items() if k not in single), text)


def harmonise_ligatures(text: Column) -> Column:
    return substitute(text, LIGATURES)


def harmonise_punctuation(text: Column) -> Column:
    return substitute(text, PUNCTUATION)


def harmonise_non_printable(text: Column) -> Column:
    return substitute(text, NON_PRINTABLE)


def harmonise_symbols(text: Column) -> Column:
    return substitute(text, SYMBOLS)


def harmonise_spaces(text: Column) -> Column:
    """Every run of Unicode white space becomes a space."""
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def harmonise(text: Column, steps=(harmonise_punctuation, harmonise_symbols, harmonise_ligatures, harmonise_spaces)) -> Column:
    return reduce(lambda t, f: f(t), steps, text)


def count_charset(text: Column, charset: str, decomposed: bool = False) -> Column:
    """Characters of a charset; decomposed: of a text in NFD."""
    return F.regexp_count(text, F.lit(f"[{(CHARSETS_NFD if decomposed else CHARSETS)[charset]}]")).cast("long")


def char_charset(char: Column, fallback: str = "fallback") -> Column:
    """The first charset, in the order of CHARSETS, that has the character."""
    found = F.when(F.lit(False), F.lit(""))
    for name, members in CHARSETS.items():
        found = found.when(char.rlike(f"^[{members}]$"), F.lit(name))
    return found.otherwise(F.lit(fallback))


def is_charset(text: Column, charset: str, share: float = 0.5, strict: bool = False, decomposed: bool = False) -> Column:
    """Whether the share of a charset's characters is reached; numerals and punctuation count too unless strict. False for empty texts."""
    n = count_charset(text, charset, decomposed)
    if not strict:
        n = n + sum(count_charset(text, c, decomposed) for c in ("numeral", "punctuation") if c != charset)
    return F.coalesce(F.try_divide(n.cast("double"), F.char_length(text)) >= share, F.lit(False))


def string_charset(text: Column) -> Column:
    """The charset of most characters; ties in the order latin, greek, numeral, punctuation, fallback."""
    names = [*CHARSETS, "fallback"]
    chars = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: char_charset(c))
    having = lambda n: F.size(F.filter(chars, lambda c: c == n))
    counts = F.array(*[F.struct(having(n).alias("n"), F.lit(-i).alias("r"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    return F.array_max(counts)["name"]


def basic_clean(text: Column) -> Column:
    """White space to single spaces, stripped, then URLs out (their spaces stay)."""
    return F.regexp_replace(F.trim(harmonise_spaces(text)), URL, "")


def harmonise_linebreaks(text: Column) -> Column:
    """Three line breaks or more end documents, two end regions, single ones are spaces."""
    t = F.regexp_replace(text, r"\n{3,}", "\u0001")
    t = F.regexp_replace(t, r"\n{2}", "\u0002")
    t = F.regexp_replace(F.regexp_replace(t, r"\n", " "), " +", " ")
    return F.replace(F.replace(t, F.lit("\u0001"), F.lit("\n\n\n")), F.lit("\u0002"), F.lit("\n\n"))


def remove_weblinks(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, URL, ""), EMAIL, "")


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)(\w+)- (\w+)", "$1$2")


def clean_marks(text: Column) -> Column:
    """Alignment marks out, words broken by a not-sign joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[#@]", ""), "¬[ \n]?", ""), r"\s+", " "))


def greek_ratio(text: Column) -> Column:
    return F.try_divide(count_charset(text, "greek").cast("double"), F.char_length(text))


def base_code(number: Column, alphabet: str, least: int = 1) -> Column:
    """A non-negative whole number below 2**63 in the base of an alphabet, padded to `least` places."""
    base, places = len(alphabet), 1
    while len(alphabet) ** places < 1 << 63:
        places += 1
    n = number.cast("long")
    # whole division: a quotient of decimals is rounded, up to the next digit just below a multiple of a power
    sign = lambda k: F.substring(F.lit(alphabet), (F.call_function("div", n, F.lit(base**k).cast("long")) % base + 1).cast("int"), F.lit(1))
    return F.concat(*[sign(k) if k < least else F.when(n >= F.lit(base**k).cast("long"), sign(k)).otherwise("") for k in range(places - 1, -1, -1)])


# Greek stop words as Latin readers misprint them.
LATINISED_STOPWORDS = ("kai", "kal", "tovto", "tov", "yap")


def latinised_stopwords(text: Column, lower: bool = True) -> Column:
    words = F.split(F.lower(text) if lower else text, r"\s+")
    return F.size(F.filter(words, lambda w: w.isin(*LATINISED_STOPWORDS))).cast("long")


def strip_boilerplate(text: Column, fixed: tuple[str, ...] = ()) -> Column:
    """Fixed strings, lines of page numbers and embedded files out."""
    text = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit("")), fixed, text)
    return F.regexp_replace(F.regexp_replace(text, r"(?s)%PDF.*?%%EOF", ""), r"\n[0-9XVILC ]+\n", "\n")


def marked_scripts(text: Column) -> Column:
    """Raised signs to \\x02 and lowered ones to \\x03 with the base sign."""
    return substitute(substitute(text, {k: "\x02" + v for k, v in SUPERSCRIPTS.items()}), {k: "\x03" + v for k, v in SUBSCRIPTS.items()})


def following(reference: Column) -> Column:
    """What ends in "f.": "12f." is "12-13"; any other loses all its "f."."""
    bare = F.replace(reference, F.lit("f."), F.lit(""))
    n = F.when(bare.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(bare).try_cast("long"))
    return F.when(reference.endswith("f."), F.coalesce(F.concat(n.cast("string"), F.lit("-"), (n + 1).cast("string")), bare)).otherwise(reference)


def scope(reference: Column) -> Column:
    """The part of an address that a scope names: brackets and separators out, "ff." too, "f." resolved, one comma and one stop off the end."""
    t = F.replace(F.regexp_replace(reference, r"[();:]", ""), F.lit("ff."), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(following(t), r",\z", ""), r"\.\z", "")
    return F.when(F.char_length(t) > 0, F.concat(F.lit(":"), t)).otherwise("")


def reader_url(urn: Column, reference: Column | None = None) -> Column:
    """Address of a work in a reading environment, with the scope if there is one."""
    return F.concat(F.lit("https://scaife.perseus.org/reader/"), urn, F.lit("") if reference is None else F.coalesce(scope(reference), F.lit("")))


# Bounds of texts that have Greek and were read well.
GREEK_SHARE, FEW_STOPWORDS, MORE_STOPWORDS = 0.001, 2, 10


def valid_greek(text: Column) -> Column:
    """Few misread stop words: fewer than FEW_STOPWORDS, or MORE_STOPWORDS more where a share of GREEK_SHARE is Greek. Null for empty texts."""
    most = F.when(greek_ratio(text) < GREEK_SHARE, FEW_STOPWORDS).when(greek_ratio(text) >= GREEK_SHARE, FEW_STOPWORDS + MORE_STOPWORDS)
    return latinised_stopwords(text) < most


# A text is kept with more Greek characters and more distinct ones than these; of its clean lines the longer ones.
GREEK_CHARS, GREEK_DISTINCT, LONG_LINE = 60, 10, 100


def long_greek_lines(text: Column) -> Column:
    """The clean lines of more than LONG_LINE characters of a text with enough Greek; none of any other."""
    greek = F.regexp_extract_all(text, F.lit(f"([{CHARSETS['greek']}])"), F.lit(1))
    enough = (F.size(greek) > GREEK_CHARS) & (F.size(F.array_distinct(greek)) > GREEK_DISTINCT)
    lines = F.filter(F.transform(F.split(text, "\n"), basic_clean), lambda x: F.char_length(x) > LONG_LINE)
    return F.when(enough, lines).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


@F.pandas_udf(StringType())
def nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFD", s))


@F.pandas_udf(StringType())
def remove_diacritics(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining signs."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def char_name(char: pd.Series) -> pd.Series:
    return char.map(lambda c: None if c is None else unicodedata.name(c, "") if len(c) == 1 else "")


@F.pandas_udf(StringType())
def combining_to_standalone(text: pd.Series) -> pd.Series:
    """A combining sign before a space becomes the spacing sign that decomposes into it."""
    spacing = {unicodedata.decomposition(c).split()[-1]: c for c in map(chr, range(0xA0, 0x2000)) if unicodedata.decomposition(c).startswith("<compat> 0020 ")}

    def one(s: str | None) -> str | None:
        return None if s is None else re.sub(r"([̀-ͯ]) ", lambda m: spacing.get(f"{ord(m[1]):04X}", m[0]), s)

    return text.map(one)


# Beta code.
BETA = dict(zip("abgdezhqiklmncoprstufxyw", "αβγδεζηθικλμνξοπρστυφχψω"))
BETA_MARKS = {")": "̓", "(": "̔", "/": "́", "\\": "̀", "=": "͂", "+": "̈", "|": "ͅ"}


def beta_code(s: str) -> str:
    """Beta code to Greek; * starts a capital, whose marks come before the letter."""
    out, i = [], 0
    while i < len(s):
        c = s[i].lower()
        if c == "*":
            j = i + 1
            while j < len(s) and s[j] in BETA_MARKS:
                j += 1
            if j < len(s) and s[j].lower() in BETA:
                out.append(BETA[s[j].lower()].upper() + "".join(BETA_MARKS[m] for m in s[i + 1 : j]))
                i = j + 1
                continue
            out.append("*")
        else:
            out.append(BETA.get(c) or BETA_MARKS.get(c) or s[i])
        i += 1
    return unicodedata.normalize("NFC", re.sub(r"σ(?![\ẁ-ͯ])", "ς", "".join(out)))


@F.pandas_udf(StringType())
def beta_to_greek(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else beta_code(s))
