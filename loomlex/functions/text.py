"""Scalar text functions as Column expressions; all stay inside the JVM.

NULL counts as missing text throughout: unless a function says otherwise it treats NULL as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Historical Cyrillic letters with one modern letter each, and those with two.
HISTORICAL, MODERN = "ѣѢіІѳѲѵѴѫѪѭѬѧѦѩѨѿѾҁҀ", "еЕиИфФиИуУюЮяЯяЯоОоО"
HISTORICAL_PAIRS = (("ѯ", "кс"), ("Ѯ", "Кс"), ("ѱ", "пс"), ("Ѱ", "Пс"))
#: Labels without meaning of their own in frequency lists, and prefixes of such labels.
STOP_LABELS = (
    "a an and are as at be by com doi edn et for from has have http https in into is issn it of on or org our russ rus that the these this those to was we were with "
    "ал без бы быть весь для до его ее если же за из или их источник как кто ли мочь на над не нет но о об он она они от по под при раздел с составить со так такой тот то у являться "
    "ключевой дата обращение ссылка автор что это"
).split()
STOP_PREFIXES = ("10.", "doi", "edn", "issn", "http", "www", "fig", "table")
#: Marks around a hit, and the tags they become.
MARK_START, MARK_END = "[[HIT_START]]", "[[HIT_END]]"

_LETTER = "A-Za-z\\u0400-\\u052f"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of any white space made one blank, none at the ends (SCL1)."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def squeeze_lines(c: Column) -> Column:
    """As :func:`squeeze` by line, blank runs of lines cut to one empty line (SCL8)."""
    x = F.regexp_replace(F.replace(text(c), F.lit("\r"), F.lit("\n")), r"[^\S\n]+", " ")
    return strip(F.regexp_replace(F.regexp_replace(x, " *\n *", "\n"), "\n{3,}", "\n\n"))


def modern_cyrillic(c: Column) -> Column:
    """Historical letters in modern spelling (SCL2)."""
    out = F.translate(text(c), HISTORICAL, MODERN)
    for a, b in HISTORICAL_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def token_language(token: Column, article_language: Column) -> Column:
    """'en' for Latin tokens, 'cu' for Cyrillic ones with historical letters, 'ru' for other
    Cyrillic ones, else the article's language (SCL3)."""
    old = f"[{HISTORICAL}{''.join(a for a, _ in HISTORICAL_PAIRS)}]"
    return (
        F.when(token.rlike("^[A-Za-z][A-Za-z-]*$"), "en")
        .when(token.rlike("^[\\u0400-\\u052F-]+$"), F.when(token.rlike(old), "cu").otherwise("ru"))
        .otherwise(article_language)
    )


def search_config(query: Column) -> Column:
    """'english' for Latin queries, else 'russian' (FTS2)."""
    return F.when(query.rlike(r"^[A-Za-z][A-Za-z\s-]*$"), "english").otherwise("russian")


def sanitize(c: Column) -> Column:
    """Extracted text without control and private-use characters, soft hyphens and cut words (SCL6)."""
    x = F.regexp_replace(text(c), "\r\n?", "\n")
    x = F.regexp_replace(x, "[\ufeff\u00ad]", "")
    x = F.regexp_replace(x, "[\u2028\u2029]", "\n")
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{E000}-\\x{F8FF}]", " ")
    x = F.regexp_replace(x, f"(?<=[{_LETTER}])-(?U:\\s*)\n(?U:\\s*)(?=[{_LETTER}])", "")
    x = F.regexp_replace(x, "[ \t\f\\x0b]+", " ")
    x = F.regexp_replace(x, " *\n *", "\n")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def private_use_count(c: Column) -> Column:
    """Characters of the private-use area (SCL7)."""
    return F.regexp_count(text(c), F.lit("[\\x{E000}-\\x{F8FF}]"))


def quality(c: Column, min_words: int = 120) -> Column:
    """Struct of counts, shares and flags that tell unusable text (SCL9)."""
    clean = sanitize(c)
    chars = F.length(clean)
    words = F.regexp_count(clean, F.lit(f"[{_LETTER}]{{2,}}"))
    alpha = F.regexp_count(clean, F.lit(f"[{_LETTER}]"))
    lines = F.filter(F.transform(F.split(clean, "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}]"), squeeze), lambda s: s != "")
    single = F.size(F.filter(lines, lambda s: s.rlike(r"(?U)^\W?.\W?$")))
    count = F.size(lines)
    density = F.when(chars > 0, alpha / chars).otherwise(0.0)
    ratio = F.when(count > 0, single / count).otherwise(0.0)
    private = private_use_count(c)
    flags = F.array_compact(F.array(
        F.when(chars == 0, "empty_text"),
        F.when(private > 0, "private_use_symbols"),
        F.when((words > 0) & (words < min_words), "suspiciously_short_text"),
        F.when((chars > 0) & (density < 0.35), "low_alpha_density"),
        F.when((count >= 20) & (ratio > 0.25), "fragmented_lines"),
    ))
    return F.struct(chars.alias("char_count"), words.alias("word_count"), private.alias("private_use_count"), density.alias("alpha_density"), ratio.alias("one_char_line_ratio"), flags.alias("flags"))


def flatten(*parts: Column) -> Column:
    """Sanitised non-blank parts, joined by an empty line (SCL12)."""
    return F.concat_ws("\n\n", *(F.nullif(sanitize(p), F.lit("")) for p in parts))


def paragraphs(c: Column) -> Column:
    """Paragraphs, each on one line (SCL11)."""
    return F.filter(F.transform(F.split(F.regexp_replace(text(c), "\r\n?", "\n"), r"\n(?U:\s*)\n"), squeeze), lambda s: s != "")


def city_key(c: Column) -> Column:
    """City names without case, 'г.', 'город ' and marks; the removal also hits inner places (SCL21)."""
    x = F.replace(F.lower(squeeze(c)), F.lit("ё"), F.lit("е"))
    x = F.replace(F.replace(x, F.lit("г."), F.lit("")), F.lit("город "), F.lit(""))
    return squeeze(F.regexp_replace(x, "[^a-zа-я0-9 -]+", " "))


def escape_html(c: Column) -> Column:
    x = text(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def render_marks(c: Column) -> Column:
    """Escaped text with marked hits in <mark> tags (SCL23)."""
    x = escape_html(c)
    return F.replace(F.replace(x, F.lit(MARK_START), F.lit("<mark>")), F.lit(MARK_END), F.lit("</mark>"))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(text(c), "<[^>]*>", "")


def joined(sep: str, *parts: Column) -> Column:
    """Non-empty parts joined by ``sep``."""
    return F.concat_ws(sep, *(F.nullif(text(p), F.lit("")) for p in parts))


def full_name(last: Column, first: Column, middle: Column) -> Column:
    """SCL25."""
    return joined(" ", last, first, middle)


def issue_label(year: Column, volume: Column, number: Column) -> Column:
    """SCL25."""
    return F.concat_ws(" ", year.cast("string"), F.when(text(volume) != "", F.concat(F.lit("Т. "), volume)), F.when(text(number) != "", F.concat(F.lit("№ "), number)))


def city_label(name: Column, region: Column, country: Column) -> Column:
    """SCL25."""
    return joined(", ", name, F.when(text(region) != text(name), region), country)


def has(a: Column, b: Column) -> Column:
    """``a`` contains ``b`` whatever the case; wild cards have no meaning (SCL28)."""
    return F.contains(F.lower(text(a)), F.lower(text(b)))


def meaningful(label: Column, mode: str = "curated", scripts: str = "exclude_latin") -> Column:
    """Whether a label belongs in a frequency list (FLT5).

    'all' keeps what isn't blank.  'curated' wants three characters or more, no stop label or
    prefix, no digit, letters and hyphens only and, unless ``scripts`` is 'any', not only ASCII letters.
    """
    x = F.lower(squeeze(label))
    if mode == "all":
        return x != ""
    good = (F.length(x) >= 3) & ~x.isin(*STOP_LABELS) & ~x.rlike("^(" + "|".join(p.replace(".", "\\.") for p in STOP_PREFIXES) + ")") & ~x.rlike("\\p{Nd}")
    if scripts != "any":
        good = good & ~x.rlike("^[a-z][a-z-]*$")
    return good & F.replace(x, F.lit("-"), F.lit("")).rlike("^\\p{L}+$")


def label_matches(label: Column, query: str | None) -> Column:
    """Filter of frequency tables (FLT6): short queries name a whole word, longer ones begin a word
    or stand anywhere."""
    q = " ".join((query or "").split()).lower()
    if not q:
        return F.lit(True)
    x = F.lower(text(label))
    words = F.split(x, " +")
    if len(q) <= 2:
        return (x == q) | F.array_contains(words, q)
    return F.exists(words, lambda w: F.startswith(w, F.lit(q))) | F.contains(x, F.lit(q))


def file_kind(name: Column) -> Column:
    """By suffix (SCL20)."""
    suffix = F.lower(F.regexp_extract(text(name), r"\.([A-Za-z0-9]+)$", 1))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("doc", "docx"), "docx").when(suffix.isin("txt", "md"), "txt").otherwise("other")


def parse_date(c: Column) -> Column:
    """Dates in three spellings, else NULL (SCL30)."""
    x = squeeze(c)
    return F.coalesce(*(F.try_to_date(x, f) for f in ("y/M/d", "y-M-d", "d.M.y")))


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(squeeze(c), " "), 1, n), " ")


def split_name(c: Column) -> Column:
    """'last first middle…' as typed by editors: struct of the three; dots count as blanks (SCL17)."""
    w = F.split(squeeze(F.replace(text(c), F.lit("."), F.lit(" "))), " ")
    return F.struct(F.get(w, 0).alias("last_name"), text(F.get(w, 1)).alias("first_name"), F.array_join(F.slice(w, F.lit(3), F.greatest(F.size(w) - 2, F.lit(0))), " ").alias("middle_name"))


def split_crawled_name(c: Column) -> Column:
    """'first middle… last' as crawled: struct (last, first, middle) (SCL18)."""
    w = F.split(squeeze(F.replace(text(c), F.lit("."), F.lit(" "))), " ")
    n = F.size(w)
    last = F.when(n == 1, F.get(w, 0)).otherwise(F.element_at(w, -1))
    return F.struct(
        last.alias("last_name"), F.when(n > 1, F.get(w, 0)).otherwise("").alias("first_name"),
        F.when(n > 2, F.array_join(F.slice(w, F.lit(2), n - 2), " ")).otherwise("").alias("middle_name"),
    )


def describe_payload(p: Column) -> Column:
    """Lines that describe a saved filter, a map of strings (SCL26)."""
    v = lambda k: text(F.try_element_at(p, F.lit(k)))
    line = lambda name, k: F.when(v(k) != "", F.concat(F.lit(name + ": "), v(k)))
    years = (
        F.when((v("year_from") != "") & (v("year_to") != ""), F.concat(F.lit("Годы: "), v("year_from"), F.lit("–"), v("year_to")))
        .when(v("year_from") != "", F.concat(F.lit("Год от: "), v("year_from")))
        .when(v("year_to") != "", F.concat(F.lit("Год до: "), v("year_to")))
    )
    return F.array_compact(F.array(line("Запрос", "text_query"), line("Название", "title"), years, line("Том", "volume"), line("Номер", "number"), line("Автор", "author"), line("Язык", "language"), line("Ключевое слово", "keyword")))


def clean_payload(p: Column) -> Column:
    """A saved filter without page keys and empty values (FLT3)."""
    return F.map_filter(p, lambda k, v: ~k.isin("saved_query", "subcorpus", "page") & v.isNotNull() & ~v.isin("", "[]", "None"))


def subcorpus_payload(p: Column) -> Column:
    """FLT3: a mode without a query says nothing."""
    q = clean_payload(p)
    return F.when(text(F.try_element_at(q, F.lit("text_query"))) == "", F.map_filter(q, lambda k, v: k != "search_mode")).otherwise(q)


def has_filters(p: Column) -> Column:
    """FLT18: any key besides the mode."""
    return F.size(F.map_filter(clean_payload(p), lambda k, v: k != "search_mode")) > 0


def query_string(p: Column) -> Column:
    """URL query of a map, keys in order; a value that is a JSON list gives its key once an entry (SCL27)."""
    part = lambda k, v: F.concat(F.url_encode(k), F.lit("="), F.url_encode(v))
    many = lambda v: F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>"))
    pairs = F.transform(F.array_sort(F.map_entries(p)), lambda e: F.transform(F.coalesce(many(e["value"]), F.array(e["value"])), lambda v: part(e["key"], v)))
    return F.array_join(F.flatten(pairs), "&")


#: The upper half of Windows-1251 in order; byte 152 is open and stands for its control.
CP1251 = "".join(bytes([b]).decode("cp1251") if b != 152 else chr(152) for b in range(128, 256))


def repair_cp1251(c: Column) -> Column:
    """Text whose UTF-8 bytes were read as Windows-1251; unchanged when that can't be (SCL22).

    Every character is brought to the Latin-1 character of its byte, and the bytes are read as UTF-8.
    """
    good = ~c.rlike(f"[^\\x00-\\x7f{CP1251}]")
    raw = F.encode(F.translate(F.when(good, c).otherwise(""), CP1251, "".join(map(chr, range(128, 256)))), "ISO-8859-1").cast("string")
    return F.when(good & F.is_valid_utf8(raw), raw).otherwise(c)


def truncate(c: Column, most: int = 220) -> Column:
    """At most ``most`` characters, the last one an ellipsis where text was cut (SCL24)."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def fingerprint(parts: Column) -> tuple[Column, ...]:
    """Aggregates that tell a set of strings whatever its order, in constant space: number, exclusive or
    and sum of 60-bit hashes (SCL34)."""
    h = F.conv(F.substring(F.md5(parts), 1, 15), 16, 10).cast("long")
    return F.count(parts).alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("s")


def signature(parts: Column) -> Column:
    """SHA-1 of :func:`fingerprint`."""
    return F.sha1(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in fingerprint(parts))))


def title_rank(c: Column) -> Column:
    """Rank of the first letter's script: Cyrillic, Latin, other."""
    x = strip(c)
    return F.when(x.rlike("^[\\u0400-\\u052F]"), 0).when(x.rlike("^[A-Za-z]"), 1).otherwise(2)


def pick_page_text(plain: Column, layout: Column) -> Column:
    """Plain page text when clearly longer than the layout text (SRC10)."""
    return F.when(F.length(strip(plain)) > 1.2 * F.length(strip(layout)), plain).otherwise(layout)


def extraction_score(words: Column, chars: Column, private: Column, empty_pages: Column, image_pages: Column) -> Column:
    """Score of one engine's text; the greater wins (SRC9)."""
    return 10 * words + chars - 1000 * private - 450 * empty_pages - 250 * image_pages
