"""Queries on text functions: harmonising, scripts, clean-up, corpus filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans import model as M
from quire.plans.model import sql, table
from quire.plans.registry import query

#: Every sign that the functions are about, beside some that they leave alone, stands in each text as read by messy().
SIGNS_TEXT = "\u2550\u201F\u2E17\u25CF\u27E8\u27E9\u2010\u2011\u2012\u2015\u2025\u2026\u2027\u2032\u2033\uFF08\uFF09\u0375\u02B9\u02BA\u02BB\u02BC\u02BD\u02C8\u02CA\u02CB\u02CC\x92\x01\x08\x9e\x8e\x81\xad\u2053\u223C\u27B3\u21D2\u21D4\u21D0\u27A4\u02D6\u00D7\u201B\u03F0\u03F1\u03D1\uA759\uA75B\uA758\uA75A\uA753\uA750\U0001F130\U0001F13C\U0001F149\u2E22\u2E23\u2E24\u230B\u2308\u2E25\u2044\u00B5\u2018\u201C\u2014\u00AB\u2126\u1FBD\u03E2\u03E1\u0384\u00B7\u00A8\u0300\u0345 \u00A0\u2003\u0085"
LIGATURES_TEXT = "\uFB00\uFB01\uFB02\uFB03\uFB04\uFB05\uFB06"


def as_chr(s: str) -> str:
    return " || ".join(f"chr({ord(c)})" for c in s)


MESSY_SQL = f"messy AS (SELECT doc_id, source, translate(text, 'éñü', {as_chr(LIGATURES_TEXT[1:4])}) || {as_chr(LIGATURES_TEXT)} || {as_chr(SIGNS_TEXT)} AS text FROM documents)"


def messy(spark, d):
    return table(spark, d, "documents").select("doc_id", "source", F.concat(F.translate("text", "éñü", LIGATURES_TEXT[1:4]), F.lit(LIGATURES_TEXT + SIGNS_TEXT)).alias("text"))


def replaced(expr: str, pairs: str) -> str:
    """Replacements given as "code:text" with codes in hexadecimal, one after the other."""
    for pair in pairs.split():
        code, text = pair.split(":", 1)
        expr = f"replace({expr}, chr({int(code, 16)}), '{text.replace(chr(39), chr(39) * 2)}')"
    return expr


#: The tables once more, written out by code point for the oracle.
SQL_LIGATURES = "FB00:ff FB01:fi FB02:fl FB03:ffi FB04:ffl FB05:ft FB06:st"
SQL_PUNCTUATION = "2550:= 201F:\" 2E17:— 25CF:• 27E8:〈 27E9:〉 2010:- 2011:- 2012:- 2015:- 2025:.. 2026:... 2027:· 2032:' 2033:\" FF08:( FF09:) 375:, 2B9:' 2BA:\" 2BB:' 2BC:' 2BD:' 2C8:' 2CA:' 2CB:' 2CC:, 92:'"
SQL_CONTROL = "1: 2: 3: 4: 5: 6: 7: 8: 92:' 9E:ï 8E:ï 81:ï AD:-"
SQL_SYMBOLS = (
    "9E:ï 8E:ï 81:ï AD:- 2053:~ 223C:~ 27B3:→ 21D2:→ 21D4:↔ 21D0:← 27A4:→ 2D6:+ 2BC:' D7:x 201F:\" 201B:' 3F0:κ 3F1:ρ 3D1:θ A759:q A75B:r A758:Q A75A:R A753:p A750:P "
    "1F130:A 1F131:B 1F132:C 1F133:D 1F134:E 1F135:F 1F136:G 1F137:H 1F138:I 1F139:J 1F13A:K 1F13B:L 1F13C:M 1F13D:N 1F13E:O 1F13F:P 1F140:Q 1F141:R 1F142:S 1F143:T 1F144:U 1F145:V 1F146:W 1F147:X 1F148:Y 1F149:Z "
    "2E22:[ 2E23:] 2E24:[ 230B:] 2308:[ 2E25:] 2044:/ B5:μ"
)
SQL_CLASSES = {
    "latin": "A-Za-zÀ-ÿŒœ",
    "greek": "".join("-".join(f"\\x{{{c}}}" for c in r.split("-")) for r in "386-38A 38C 38E-3A1 3A3-3E1 1F00-1F15 1F18-1F1D 1F20-1F45 1F48-1F4D 1F50-1F57 1F59 1F5B 1F5D 1F5F-1F7D 1F80-1FB4 1FB6-1FBC 1FBE 1FC2-1FC4 1FC6-1FCC 1FD0-1FD3 1FD6-1FDB 1FE0-1FEC 1FF2-1FF4 1FF6-1FFC 2126 300 301 313 314 345 342 308 B7 384".split()),
    "numeral": "0-9",
    "punctuation": "\\x{20}-\\x{2F}\\x{3A}-\\x{3F}\\x{5B}-\\x{60}\\x{7B}-\\x{7E}\\x{A8}\\x{B7}",
}
SQL_SPACES = "[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


@query("t01_ligatures", f"WITH {MESSY_SQL} SELECT doc_id, {replaced('text', SQL_LIGATURES)} AS text FROM messy")
def ligatures(spark, d):
    """T-01."""
    return messy(spark, d).select("doc_id", T.harmonise_ligatures(F.col("text")).alias("text"))


@query("t03_punctuation", f"WITH {MESSY_SQL} SELECT doc_id, {replaced('text', SQL_PUNCTUATION)} AS text FROM messy")
def punctuation(spark, d):
    """T-03."""
    return messy(spark, d).select("doc_id", T.harmonise_punctuation(F.col("text")).alias("text"))


@query("t04_non_printable", f"WITH {MESSY_SQL} SELECT doc_id, {replaced('text', SQL_CONTROL)} AS text FROM messy")
def non_printable(spark, d):
    """T-04."""
    return messy(spark, d).select("doc_id", T.harmonise_non_printable(F.col("text")).alias("text"))


@query("t05_symbols", f"WITH {MESSY_SQL} SELECT doc_id, {replaced('text', SQL_SYMBOLS)} AS text FROM messy")
def symbols(spark, d):
    """T-05."""
    return messy(spark, d).select("doc_id", T.harmonise_symbols(F.col("text")).alias("text"))


@query("t02_t06_harmonise", f"WITH {MESSY_SQL} SELECT doc_id, regexp_replace({replaced(replaced(replaced('text', SQL_PUNCTUATION), SQL_SYMBOLS), SQL_LIGATURES)}, '{SQL_SPACES}', ' ', 'g') AS text FROM messy")
def harmonise(spark, d):
    """T-02, T-06: punctuation, symbols, ligatures, spaces."""
    return messy(spark, d).select("doc_id", T.harmonise(F.col("text")).alias("text"))


def sql_count(charset: str, expr: str = "text") -> str:
    return f"(length({expr}) - length(regexp_replace({expr}, '[{SQL_CLASSES[charset]}]', '', 'g')))"


#: A text in which every fourth document is transliterated, so that there is Greek to count.
MIXED_SQL = f"mixed AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN translate(text, 'aeiousrtnldm', 'αειουσρτνλδμ') ELSE text END AS text FROM messy)"


def mixed(spark, d):
    t = F.col("text")
    return messy(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.translate(t, "aeiousrtnldm", "αειουσρτνλδμ")).otherwise(t).alias("text"))


@query("t08_t11_charset_counts", f"WITH {MESSY_SQL}, {MIXED_SQL} SELECT doc_id, " + ", ".join(f"{sql_count(c)}::BIGINT AS {c}" for c in SQL_CLASSES) + " FROM mixed")
def charset_counts(spark, d):
    """T-08, T-11: characters by charset."""
    return mixed(spark, d).select("doc_id", *[T.count_charset(F.col("text"), c).alias(c) for c in T.CHARSETS])


NFD_LATIN, NFD_GREEK_BASE = "A-Za-z\\x{C6}\\x{D0}\\x{D7}\\x{D8}\\x{DE}\\x{DF}\\x{E6}\\x{F0}\\x{F7}\\x{F8}\\x{FE}\\x{152}\\x{153}\\x{300}\\x{301}\\x{302}\\x{303}\\x{308}\\x{30A}\\x{327}", "[αειουσρτνλ]"


@query("t11_t13_decomposed", f"WITH {MESSY_SQL}, {MIXED_SQL} SELECT doc_id, (length(t) - length(regexp_replace(t, '[{NFD_LATIN}]', '', 'g')))::BIGINT AS latin, coalesce((length(t) - length(regexp_replace(t, '[{NFD_LATIN}]', '', 'g'))) / nullif(length(t), 0)::DOUBLE >= 0.7, false) AS is_latin FROM (SELECT doc_id, text, replace(replace(replace(replace(replace(replace(replace(text, 'é', 'e' || chr(769)), 'è', 'e' || chr(768)), 'ñ', 'n' || chr(771)), 'ü', 'u' || chr(776)), 'ö', 'o' || chr(776)), 'ä', 'a' || chr(776)), 'ç', 'c' || chr(807)) AS t FROM (SELECT doc_id, text FROM documents))")
def decomposed_counts(spark, d):
    """T-11, T-13 on decomposed texts."""
    t = table(spark, d, "documents").select("doc_id", F.translate("text", "éèñüöäç", "éèñüöäç").alias("text"))
    for whole, parts in (("é", "e\u0301"), ("è", "e\u0300"), ("ñ", "n\u0303"), ("ü", "u\u0308"), ("ö", "o\u0308"), ("ä", "a\u0308"), ("ç", "c\u0327")):
        t = t.withColumn("text", F.replace("text", F.lit(whole), F.lit(parts)))
    c = F.col("text")
    return t.select("doc_id", T.count_charset(c, "latin", decomposed=True).alias("latin"), T.is_charset(c, "latin", 0.7, strict=True, decomposed=True).alias("is_latin"))


@query("t13_is_charset", f"WITH {MESSY_SQL} SELECT doc_id, coalesce({sql_count('latin')} / nullif(length(text), 0)::DOUBLE >= 0.7, false) AS latin_strict, coalesce(({sql_count('latin')} + {sql_count('numeral')} + {sql_count('punctuation')}) / nullif(length(text), 0)::DOUBLE >= 0.95, false) AS latin_loose FROM messy")
def is_charset(spark, d):
    """T-13, F-29: whether a charset's share is reached, alone or with numerals and punctuation."""
    t = F.col("text")
    return messy(spark, d).select("doc_id", T.is_charset(t, "latin", 0.7, strict=True).alias("latin_strict"), T.is_charset(t, "latin", 0.95).alias("latin_loose"))


CHAR_CASE = "CASE " + " ".join(f"WHEN regexp_matches(c, '^[{members}]$') THEN '{name}'" for name, members in SQL_CLASSES.items()) + " ELSE 'fallback' END"


@query("t09_char_charsets", f"WITH {MESSY_SQL}, {MIXED_SQL} SELECT charset, count(*) AS n FROM (SELECT {CHAR_CASE} AS charset FROM (SELECT unnest(string_split(text, '')) AS c FROM mixed)) GROUP BY charset")
def char_charsets(spark, d):
    """T-09, A-22: characters by their first charset."""
    chars = mixed(spark, d).select(F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    return chars.groupBy(T.char_charset(F.col("c")).alias("charset")).agg(F.sum("n").alias("n"))


@query("t10_a19_string_charset", sql("SELECT charset, count(*) AS n FROM (SELECT arg_max(charset, k * 10 - CASE charset WHEN 'latin' THEN 0 WHEN 'greek' THEN 1 WHEN 'numeral' THEN 2 WHEN 'punctuation' THEN 3 ELSE 4 END) AS charset FROM (SELECT doc_id, word_idx, charset, count(*) AS k FROM (SELECT doc_id, word_idx, " + CHAR_CASE + " AS charset FROM (SELECT doc_id, word_idx, unnest(string_split(text, '')) AS c FROM words)) GROUP BY ALL) GROUP BY doc_id, word_idx) GROUP BY charset"))
def string_charsets(spark, d):
    """T-10, A-19: a word's commonest charset, ties by rank."""
    ws = M.words(table(spark, d, "documents")).groupBy("text").agg(F.count("*").alias("n"))
    return ws.groupBy(T.string_charset(F.col("text")).alias("charset")).agg(F.sum("n").alias("n"))


@query("w16_t12_charset_runs", f"WITH w AS (SELECT DISTINCT text AS t FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS text FROM documents) WHERE text <> ''), c AS (SELECT t, i, list_extract(string_split(t, ''), i) AS c FROM w, generate_series(1, length(t)) g(i)), k AS (SELECT *, {CHAR_CASE} AS charset FROM c), o AS (SELECT *, CASE WHEN charset IS DISTINCT FROM lag(charset) OVER (PARTITION BY t ORDER BY i) THEN 1 ELSE 0 END AS opens FROM k), r AS (SELECT *, sum(opens) OVER (PARTITION BY t ORDER BY i) AS run FROM o) SELECT charset, count(*) AS n_runs, sum(len)::BIGINT AS n_chars, max(len) AS longest FROM (SELECT t, run, any_value(charset) AS charset, count(*) AS len FROM r GROUP BY t, run) GROUP BY charset")
def charset_runs(spark, d):
    """W-16, T-12: runs of one charset within distinct words."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", "[ \n]")).alias("t")).filter("t <> ''").distinct()
    chars = words.select("t", F.posexplode(F.filter(F.split("t", ""), lambda c: c != "")).alias("i", "c")).withColumn("charset", T.char_charset(F.col("c")))
    order = Window.partitionBy("t").orderBy("i")
    runs = chars.withColumn("opens", (~F.col("charset").eqNullSafe(F.lag("charset").over(order))).cast("int")).withColumn("run", F.sum("opens").over(order))
    return runs.groupBy("t", "run").agg(F.first("charset").alias("charset"), F.count("*").alias("len")).groupBy("charset").agg(F.count("*").alias("n_runs"), F.sum("len").alias("n_chars"), F.max("len").alias("longest"))


@query("t15_remove_diacritics", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def no_diacritics(spark, d):
    """T-15, X-01."""
    return table(spark, d, "documents").select("doc_id", T.remove_diacritics("text").alias("text"))


@query("t16_nfc", "SELECT doc_id, nfc_normalize(replace(text, 'é', 'e' || chr(769))) AS text FROM documents")
def composed(spark, d):
    """T-16: canonical composition."""
    return table(spark, d, "documents").select("doc_id", T.nfc(F.replace("text", F.lit("é"), F.lit("é"))).alias("text"))


@query("t17_superscripts", "SELECT doc_id, " + replaced(replaced("translate(text, '0123456789abcde', '⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉ') || '⁺⁻⁼⁽⁾ⁿªᵅᵝᶠᵍⁱᵏᵐᵒᵖᵗᵘᵛ₀₉₊₌₍₎ₐₑₒᵢⱼₖₗₘₙₚᵣₛₜᵤᵥₓ'", "2070:\x020 B9:\x021 B2:\x022 B3:\x023 2074:\x024 2075:\x025 2076:\x026 2077:\x027 2078:\x028 2079:\x029 207A:\x02+ 207B:\x02- 207C:\x02= 207D:\x02( 207E:\x02) 207F:\x02n AA:\x02a 1D43:\x02a 1D45:\x02a 1D47:\x02b 1D5D:\x02b 1D9C:\x02c 1D48:\x02d 1D49:\x02e 1DA0:\x02f 1D4D:\x02g 2071:\x02i 1D4F:\x02k 1D50:\x02m 1D52:\x02o 1D56:\x02p 1D57:\x02t 1D58:\x02u 1D5B:\x02v"), "2080:\x030 2089:\x039 208A:\x03+ 208C:\x03= 208D:\x03( 208E:\x03) 2090:\x03a 2091:\x03e 2092:\x03o 1D62:\x03i 2C7C:\x03j 2096:\x03k 2097:\x03l 2098:\x03m 2099:\x03n 209A:\x03p 1D63:\x03r 209B:\x03s 209C:\x03t 1D64:\x03u 1D65:\x03v 2093:\x03x") + " AS text FROM documents")
def superscripts(spark, d):
    """T-17: raised and lowered signs to a mark and the base sign."""
    t = F.concat(F.translate("text", "0123456789abcde", "⁰¹²³⁴⁵⁶⁷⁸⁹ᵃᵇᶜᵈᵉ"), F.lit("⁺⁻⁼⁽⁾ⁿªᵅᵝᶠᵍⁱᵏᵐᵒᵖᵗᵘᵛ₀₉₊₌₍₎ₐₑₒᵢⱼₖₗₘₙₚᵣₛₜᵤᵥₓ"))
    return table(spark, d, "documents").select("doc_id", T.marked_scripts(t).alias("text"))


URLS = "(SELECT page_id, 'See  ' || url || '  and' || chr(10) || 'mail a' || page_id || '@example.org or' AS text FROM pages)"


def with_urls(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.concat(F.lit("See  "), "url", F.lit("  and\nmail a"), "page_id", F.lit("@example.org or")).alias("text"))


@query("t18_basic_clean", f"SELECT page_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'https?://\\S+|www\\.\\S+', '', 'g') AS text FROM {URLS}")
def basic_clean(spark, d):
    """T-18."""
    return with_urls(spark, d).select("page_id", T.basic_clean(F.col("text")).alias("text"))


@query("t19_linebreaks", "SELECT doc_id, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\n{3,}', chr(1), 'g'), '\\n{2}', chr(2), 'g'), '\\n', ' ', 'g'), ' +', ' ', 'g'), chr(1), chr(10) || chr(10) || chr(10)), chr(2), chr(10) || chr(10)) AS text FROM (SELECT doc_id, replace(replace(text, '. ', chr(10) || chr(10)), ', ', chr(10) || chr(10) || chr(10) || chr(10)) AS t FROM documents)")
def linebreaks(spark, d):
    """T-19."""
    t = F.replace(F.replace("text", F.lit(". "), F.lit("\n\n")), F.lit(", "), F.lit("\n\n\n\n"))
    return table(spark, d, "documents").select("doc_id", T.harmonise_linebreaks(t).alias("text"))


@query("t20_weblinks", f"SELECT page_id, regexp_replace(regexp_replace(text, 'https?://\\S+|www\\.\\S+', '', 'g'), '[a-zA-Z09._-]+@[a-zA-Z09._-]+\\.[a-zA-Z]+', '', 'g') AS text FROM {URLS}")
def weblinks(spark, d):
    """T-20."""
    return with_urls(spark, d).select("page_id", T.remove_weblinks(F.col("text")).alias("text"))


@query("t21_dehyphenate", "SELECT doc_id, regexp_replace(replace(text, 'ti', 't- i'), '([\\p{L}\\p{N}_]+)- ([\\p{L}\\p{N}_]+)', '\\1\\2', 'g') AS text FROM documents")
def dehyphenated(spark, d):
    """T-21."""
    return table(spark, d, "documents").select("doc_id", T.dehyphenate(F.replace("text", F.lit("ti"), F.lit("t- i"))).alias("text"))


@query("t22_boilerplate", "SELECT doc_id, regexp_replace(replace(replace(text, 'the ', chr(10) || 'XIV ' || chr(10)), 'and', ''), '\\n[0-9XVILC ]+\\n', chr(10), 'g') AS text FROM documents")
def boilerplate(spark, d):
    """T-22."""
    return table(spark, d, "documents").select("doc_id", T.strip_boilerplate(F.replace("text", F.lit("the "), F.lit("\nXIV \n")), ("and",)).alias("text"))


@query("t23_alignment_marks", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, 'th', '¬ #'), '[#@]', '', 'g'), '¬[ \\n]?', '', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def alignment_marks(spark, d):
    """T-23."""
    return table(spark, d, "documents").select("doc_id", T.clean_marks(F.replace("text", F.lit("th"), F.lit("¬ #"))).alias("text"))


SQL_REFERENCE = "CASE o_orderkey % 8 WHEN 0 THEN o_orderkey || 'f.' WHEN 1 THEN '(' || o_orderkey || ' ff.' WHEN 2 THEN o_orderkey || ',' WHEN 3 THEN o_orderkey || ').' WHEN 4 THEN 'ivf.' WHEN 5 THEN 'v. 1ff.; ' || o_orderkey || 'f.' WHEN 6 THEN '();:ff.' ELSE o_orderkey || 'a.f.' END"
SQL_F = "CASE WHEN ends_with({0}, 'f.') THEN CASE WHEN regexp_full_match(replace({0}, 'f.', ''), '[0-9]+') THEN replace({0}, 'f.', '') || '-' || (replace({0}, 'f.', '')::BIGINT + 1) ELSE replace({0}, 'f.', '') END ELSE {0} END"


@query("t29_references", f"SELECT o_orderkey, as_range, CASE WHEN bare = '' THEN '' ELSE ':' || bare END AS scope, 'https://scaife.perseus.org/reader/urn:cts:' || o_orderkey || CASE WHEN bare = '' THEN '' ELSE ':' || bare END AS url FROM (SELECT o_orderkey, as_range, regexp_replace(regexp_replace(f, ',$', ''), '\\.$', '') AS bare FROM (SELECT o_orderkey, {SQL_F.format('r')} AS as_range, {SQL_F.format('x')} AS f FROM (SELECT o_orderkey, r, replace(regexp_replace(r, '[();:]', '', 'g'), 'ff.', '') AS x FROM (SELECT o_orderkey, {SQL_REFERENCE} AS r FROM orders))))")
def references(spark, d):
    """T-29: scopes of citations and their addresses."""
    k = F.col("o_orderkey")
    forms = [(k, "f."), ("(", k, " ff."), (k, ","), (k, ")."), ("ivf.",), ("v. 1ff.; ", k, "f."), ("();:ff.",), (k, "a.f.")]
    r = F.element_at(F.array(*[F.concat(*[x if x is k else F.lit(x) for x in form]) for form in forms]), (k % 8 + 1).cast("int"))
    o = table(spark, d, "orders").select("o_orderkey", r.alias("r"))
    return o.select("o_orderkey", T.following(F.col("r")).alias("as_range"), T.scope(F.col("r")).alias("scope"), T.reader_url(F.concat(F.lit("urn:cts:"), k), F.col("r")).alias("url"))


@query("t31_line_anchors", sql("SELECT doc_id, line_idx, regexp_extract(t, '^(\\d{1,3})[\\s.]', 1)::INT AS anchor, len(string_split(t, ' ')) AS n_words FROM (SELECT doc_id, line_idx, CASE WHEN line_idx % 3 = 0 THEN (line_idx * 37 % 1200) || '. ' ELSE '' END || line AS t FROM ln) WHERE regexp_matches(t, '^\\d{1,3}[\\s.]')"))
def line_anchors(spark, d):
    """T-31: line numbers that anchor a comment."""
    ls = M.lines(table(spark, d, "documents"))
    t = F.concat(F.when(F.col("line_idx") % 3 == 0, F.concat(F.col("line_idx") * 37 % 1200, F.lit(". "))).otherwise(""), "line")
    ls = ls.select("doc_id", "line_idx", t.alias("t")).filter(F.col("t").rlike(r"^\d{1,3}[\s.]"))
    return ls.select("doc_id", "line_idx", F.regexp_extract("t", r"^(\d{1,3})[\s.]", 1).cast("int").alias("anchor"), F.size(F.split("t", " ")).alias("n_words"))


GREEKED = "greeked AS (SELECT doc_id, source, CASE WHEN doc_id % 4 = 0 THEN translate(text, 'aeiousrtnldm', 'αειουσρτνλδμ') WHEN doc_id % 4 = 1 THEN replace(text, 'the', 'kai') WHEN doc_id % 4 = 2 THEN translate(text, 'ae', 'αε') ELSE text END AS text FROM documents)"


def greeked(spark, d):
    """Documents of which some are (partly) transliterated."""
    k, t = F.col("doc_id"), F.col("text")
    return table(spark, d, "documents").select("doc_id", "source", F.when(k % 4 == 0, F.translate(t, "aeiousrtnldm", "αειουσρτνλδμ")).when(k % 4 == 1, F.replace(t, F.lit("the"), F.lit("kai"))).when(k % 4 == 2, F.translate(t, "ae", "αε")).otherwise(t).alias("text"))


GR = f"({sql_count('greek')} / nullif(length(text), 0)::DOUBLE)"
LS = "len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w IN ('kai', 'kal', 'tovto', 'tov', 'yap')))"


@query("f21_valid_greek", f"WITH {GREEKED} SELECT doc_id, CASE WHEN g < 0.001 THEN s < 2 ELSE s < 12 END AS valid FROM (SELECT doc_id, {GR} AS g, {LS} AS s FROM greeked) WHERE g IS NOT NULL UNION ALL SELECT doc_id, NULL FROM greeked WHERE text = ''")
def valid_greek(spark, d):
    """F-21: documents whose Greek was read as Greek, by its share and by misread stop words."""
    return greeked(spark, d).select("doc_id", T.valid_greek(F.col("text")).alias("valid"))


@query("f24_long_greek_lines", f"WITH {GREEKED}, g AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_filter(string_split(text, ''), lambda c: regexp_matches(c, '[{SQL_CLASSES['greek']}]')) AS gc FROM greeked) SELECT doc_id, len(ls) AS n_lines, list_sum(list_transform(ls, lambda x: length(x)))::BIGINT AS n_chars FROM (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(trim(regexp_replace(x, '\\s+', ' ', 'g')), 'https?://\\S+|www\\.\\S+', '', 'g')), lambda x: length(x) > 100) AS ls FROM g WHERE len(gc) > 60 AND len(list_distinct(gc)) > 10) WHERE len(ls) > 0")
def long_greek_lines(spark, d):
    """F-24: the long clean lines of documents with enough Greek."""
    x = greeked(spark, d).select("doc_id", T.long_greek_lines(F.col("text")).alias("ls")).filter(F.size("ls") > 0)
    return x.select("doc_id", F.size("ls").alias("n_lines"), F.aggregate("ls", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n_chars"))


@query("f22_gibberish", sql("SELECT doc_id, line_idx FROM ln WHERE length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 0.8 * length(line)"))
def gibberish(spark, d):
    """F-22: lines with enough letters."""
    return M.lines(table(spark, d, "documents")).filter(F.regexp_count("line", F.lit("[A-Za-z]")) > 0.8 * F.char_length("line")).select("doc_id", "line_idx")


GREEK_WORDS = f"list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' AND length(w) - length(regexp_replace(w, '[{SQL_CLASSES['greek']}]', '', 'g')) >= 0.9 * length(w))"


@query("f23_greek_keep", f"WITH {GREEKED} SELECT doc_id, len(gw) AS n_greek, len(list_distinct(string_split(array_to_string(gw, ''), ''))) AS n_distinct FROM (SELECT doc_id, text, {GREEK_WORDS} AS gw FROM greeked) WHERE len(gw) >= 1 AND len(list_distinct(string_split(array_to_string(gw, ''), ''))) > 6 AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w IN ('kai', 'kal', 'tovto', 'tov', 'yap'))) = 0")
def greek_keep(spark, d):
    """F-23: documents with Greek words of more than six letters in all, and no misread stop word."""
    words = F.filter(F.split("text", r"\s+"), lambda w: (w != "") & (F.regexp_count(w, F.lit(f"[{T.CHARSETS['greek']}]")) >= 0.9 * F.char_length(w)))
    x = greeked(spark, d).select("doc_id", "text", words.alias("gw"))
    letters = F.size(F.array_distinct(F.filter(F.split(F.array_join("gw", ""), ""), lambda c: c != "")))
    x = x.withColumns({"n_greek": F.size("gw"), "n_distinct": letters})
    return x.filter((F.col("n_greek") >= 1) & (F.col("n_distinct") > 6) & (T.latinised_stopwords(F.col("text"), lower=False) == 0)).select("doc_id", "n_greek", "n_distinct")


@query("f25_neighbour_delete", sql("SELECT doc_id, line_idx FROM (SELECT doc_id, line_idx, max(bad) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM (SELECT doc_id, line_idx, CASE WHEN contains(line, 'idiot') OR contains(line, '@') THEN 1 ELSE 0 END AS bad FROM ln)) WHERE near = 0"))
def neighbour_delete(spark, d):
    """F-25: lines next to a bad one go with it."""
    ls = M.lines(table(spark, d, "documents")).select("doc_id", "line_idx", (F.contains("line", F.lit("idiot")) | F.contains("line", F.lit("@"))).cast("int").alias("bad"))
    near = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(-1, 1)
    return ls.withColumn("near", F.max("bad").over(near)).filter("near = 0").select("doc_id", "line_idx")


@query("f26_budget", "SELECT source, doc_id, n FROM (SELECT source, doc_id, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT source, doc_id, list_sum(list_transform(list_filter(string_split(text, chr(10)), lambda l: length(l) > 100 AND NOT starts_with(l, '=')), lambda l: length(l)))::BIGINT AS n FROM documents)) WHERE before <= 20000 AND n IS NOT NULL")
def budget(spark, d):
    """F-26: documents of a source in order, until the characters of their long lines have passed the budget."""
    long_lines = F.filter(F.split("text", "\n"), lambda x: (F.char_length(x) > 100) & ~x.startswith("="))
    rows = table(spark, d, "documents").select("source", "doc_id", F.size(long_lines).alias("k"), F.aggregate(long_lines, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("n"))
    return M.prefix_sum(rows, "source", "doc_id", "n", "before").filter("before <= 20000 and k > 0").select("source", "doc_id", "n")


@query("f27_keyword_filter", "SELECT doc_id FROM documents WHERE lang = 'fr' AND (regexp_matches(text, 'que (la|le)') OR regexp_matches(coalesce(source, 'None'), 'src1[0-9]') OR regexp_matches(text, '(?i)éaux de'))")
def keyword_filter(spark, d):
    """F-27: any of some patterns in any field, and a language."""
    t = F.col("text")
    return table(spark, d, "documents").filter((F.col("lang") == "fr") & (t.rlike("que (la|le)") | F.coalesce("source", F.lit("None")).rlike("src1[0-9]") | t.rlike("(?iu)éaux de"))).select("doc_id")


@query("f28_list_filter", "SELECT source, list_sort(list(DISTINCT lang)) AS langs FROM documents GROUP BY source HAVING list_contains(list(DISTINCT lang), 'de') AND list_has_any(list(DISTINCT lang), ['es', 'fr'])")
def list_filter(spark, d):
    """F-28: groups whose list of languages holds one and meets another."""
    by = table(spark, d, "documents").groupBy("source").agg(F.sort_array(F.collect_set("lang")).alias("langs"))
    return by.filter(F.array_contains("langs", "de") & F.arrays_overlap("langs", F.array(F.lit("es"), F.lit("fr"))))


@query("f30_missing_glyphs", sql("SELECT doc_id, line_idx, translate(line, 'éèñßß', '') AS line FROM (SELECT doc_id, line_idx, line, length(line) - length(translate(line, 'éèñß', '')) AS missing FROM ln) WHERE missing <= least(0.1 * length(line), 3) AND regexp_matches(line, '[A-Za-z0-9]')"))
def missing_glyphs(spark, d):
    """F-30, U-02: lines with few signs a font lacks, those signs taken out."""
    gone = F.translate("line", "éèñß", "")
    ls = M.lines(table(spark, d, "documents")).filter((F.char_length("line") - F.char_length(gone) <= F.least(0.1 * F.char_length("line"), F.lit(3))) & F.col("line").rlike("[A-Za-z0-9]"))
    return ls.select("doc_id", "line_idx", gone.alias("line"))


@query("a20_recurrent_lines", sql("SELECT line, count(*) AS n FROM ln WHERE trim(line) <> '' GROUP BY line HAVING count(*) > 3"))
def recurrent_lines(spark, d):
    """A-20, O-05: lines that recur."""
    return M.lines(table(spark, d, "documents")).filter(F.trim("line") != "").groupBy("line").agg(F.count("*").alias("n")).filter("n > 3")


@query("a20_without_recurrent_lines", sql("SELECT doc_id, string_agg(line, chr(10) ORDER BY line_idx) AS text FROM ln WHERE line NOT IN (SELECT line FROM ln WHERE trim(line) <> '' GROUP BY line HAVING count(*) > 3) GROUP BY doc_id"))
def without_recurrent_lines(spark, d):
    """A-20: texts without them, by a left anti join."""
    ls = M.lines(table(spark, d, "documents"))
    kept = ls.join(recurrent_lines(spark, d).select("line"), "line", "left_anti")
    return kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_idx", "line"))).alias("l")).select("doc_id", F.array_join(F.col("l.line"), "\n").alias("text"))


@query("a21_corpus_stats", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean, round(stddev_samp(length(text)), 4) AS std, quantile_cont(length(text), 0.25) AS q25, quantile_cont(length(text), 0.5) AS q50, max(length(text)) AS longest FROM documents GROUP BY source")
def corpus_stats(spark, d):
    """A-21, M-04."""
    n = F.char_length("text")
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(n).alias("chars"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 4).alias("std"), F.percentile(n, 0.25).alias("q25"), F.percentile(n, 0.5).alias("q50"), F.max(n).alias("longest"))


@query("a22_glyph_inventory", "SELECT c, count(*) AS n, list_sort(list(DISTINCT lang)) AS langs FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) GROUP BY c EXCEPT SELECT c, count(*) AS n, list_sort(list(DISTINCT lang)) AS langs FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE ascii(c) < 128 GROUP BY c")
def glyph_inventory(spark, d):
    """A-22, U-02: signs beyond a set, with their languages."""
    chars = table(spark, d, "documents").select("lang", F.explode(F.filter(F.split("text", ""), lambda c: c != "")).alias("c"))
    chars = chars.groupBy("lang", "c").agg(F.count("*").alias("n")).filter(~F.col("c").rlike(r"^[\x00-\x7F]$"))
    return chars.groupBy("c").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("lang")).alias("langs"))


@query("a23_wordlist", sql("SELECT DISTINCT w, CASE WHEN regexp_matches(w, '^[a-z]') THEN upper(left(w, 1)) || substr(w, 2) ELSE w END AS capitalised FROM (SELECT regexp_replace(text, '^[^A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9]+$', '', 'g') AS w FROM words) WHERE w <> '' AND NOT regexp_matches(w, '[0-9]')"))
def wordlist(spark, d):
    """A-23: distinct words, trimmed, without those that hold digits."""
    w = F.regexp_replace("text", r"^[^A-Za-zÀ-ÿ0-9]+|[^A-Za-zÀ-ÿ0-9]+$", "")
    ws = M.words(table(spark, d, "documents")).select(w.alias("w")).distinct().filter((F.col("w") != "") & ~F.col("w").rlike("[0-9]"))
    return ws.select("w", F.when(F.col("w").rlike("^[a-z]"), F.concat(F.upper(F.left("w", F.lit(1))), F.substring("w", 2, 1 << 30))).otherwise(F.col("w")).alias("capitalised"))


@query("w14_word_chunks", "SELECT doc_id, i AS chunk, array_to_string(ws[i * 100 + 1: i * 100 + 100], ' ') AS text FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents), generate_series(0, (len(ws) - 1) // 100) g(i)")
def word_chunks(spark, d):
    """W-14: chunks of a hundred words."""
    x = table(spark, d, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("ws"))
    parts = F.transform(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(100)), lambda i: F.array_join(F.slice("ws", i + 1, 100), " "))
    return x.select("doc_id", F.posexplode(parts).alias("chunk", "text"))


@query("w14_char_chunks", "SELECT doc_id, i AS chunk, substr(text, i * 500 + 1, 500) AS text FROM documents, generate_series(0, (length(text) - 1) // 500) g(i)")
def char_chunks(spark, d):
    """W-14: chunks of five hundred characters."""
    x = table(spark, d, "documents").filter("text <> ''")
    return x.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.expr("int((char_length(text) - 1) div 500)"))).alias("chunk")).select("doc_id", "chunk", F.substring("text", F.col("chunk") * 500 + 1, F.lit(500)).alias("text"))


@query("p17_record_text", "SELECT c_custkey, lower(c_name) || ' ' || lower(c_mktsegment) || ' ' || lower(n_name) AS whole_text FROM customer JOIN nation ON c_nationkey = n_nationkey")
def record_text(spark, d):
    """P-17: fields of a record lower-cased and joined."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select("c_custkey", F.concat_ws(" ", F.lower("c_name"), F.lower("c_mktsegment"), F.lower("n_name")).alias("whole_text"))
