"""Text functions as column expressions: cleaning, hashing keys, parsers of advertisement text.

Java's `\\w`, `\\s` and `\\b` are ASCII unless `(?U)` is set, so every pattern here says which it means.  Words are runs of
letters and digits (`[\\p{L}\\p{N}]+`).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}]+"

# Transliteration of Bulgarian letters.
ONE_TO_ONE = ("абвгдезийклмнопрстуфхъ", "abvgdeziyklmnoprstufha")
DROPPED = "ь"
ONE_TO_MANY = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ю": "yu", "я": "ya"}

# Contact noise in descriptions, in the order of removal (URL, e-mail, phone, reference number).
URL = r"(?iU)(?:https?://|www\.)\S+"
EMAIL = r"(?U)[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?U)(?<![\d+])(?:\+359|00359|0)(?:[\s\-./]?\d){8,9}(?!\d)"
REFERENCE = r"(?iU)\b(?:реф(?:ерентен)?\.?\s*(?:номер|№)|ref\.?\s*(?:no\.?|№))\s*[:.]?\s*\S+"
INVISIBLE = "​‌‍⁠﻿­"

# Words that hint at a place nearby.
PLACE_HINT = (
    r"(?iU)метро|спирк|трамва|автобус|училищ|гимназ|детск[аи] градин|университет|парк|\bмол\b|магазин|супермаркет|лидл|билла|"
    r"кауфланд|фантастико|болниц|аптек|фитнес|център|\d+\s*(?:мин|м\.?\b|км)|в близост|близо до|до\s+(?:бул|ул)\."
)

# Removal notices, room slugs, city prefixes, site names.
REMOVAL_NOTICES = ("обявата е изтрита", "обявата е неактивна", "обявата е свалена", "обявата не съществува")
SEARCH_HOSTS = ("imot.bg", "www.imot.bg")


def squeezed(text: Column) -> Column:
    """All runs of white space as one space, trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), 1)


def once(value: Column, body) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct word n-grams; a shorter text is one shingle, a text without words none."""

    def slide(w: Column) -> Column:
        grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda first, i: F.concat_ws(" ", first, *[F.get(w, i + k) for k in range(1, size)]))
        short = F.when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(w) < size, short).otherwise(F.array_distinct(grams))

    return once(words(text), slide)


def exact_hash(text: Column) -> Column:
    """SHA-256 of the exact UTF-8 bytes: staleness of predictions."""
    return F.sha2(F.encode(text, "UTF-8"), 256)


def spaced_hash(text: Column) -> Column:
    """SHA-256 of the text with white space squeezed, case kept: identity of labelling tasks."""
    return F.sha2(squeezed(text), 256)


def word_hash(text: Column) -> Column:
    """SHA-256 of the lower-cased words: exact duplicates of descriptions."""
    return F.sha2(F.array_join(words(text), " "), 256)


def slug(value: Column) -> Column:
    """Latin slug of Bulgarian text, hyphens for white space."""
    out = F.translate(F.lower(value), ONE_TO_ONE[0] + DROPPED, ONE_TO_ONE[1])
    for letter, latin in ONE_TO_MANY.items():
        out = F.replace(out, F.lit(letter), F.lit(latin))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", "-")


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """Compatibility composition and full case folding."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def clean_description(text: Column, compose: bool = True) -> Column:
    """Text without contact noise, with tidy lines; null becomes empty.

    `compose=False` skips Unicode composition, for text known to be composed, and keeps the expression inside the JVM.
    """
    out = F.coalesce(nfc(text) if compose else text, F.lit(""))
    out = F.translate(out, INVISIBLE, "")
    out = F.translate(F.regexp_replace(out, "\r\n?", "\n"), " ", " ")
    for pattern in (URL, EMAIL, PHONE, REFERENCE):
        out = F.regexp_replace(out, pattern, "")
    # Line by line, as patterns over the whole text: one space for blanks, no blanks at the ends, no line without a word.
    out = F.regexp_replace(out, "[ \t]+", " ")
    out = F.regexp_replace(out, r"(?dmU)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")
    out = F.regexp_replace(out, r"(?dm)^[^\p{L}\p{N}\n]+(?:\n|\z)", "")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")


def place_hint(text: Column) -> Column:
    return text.rlike(PLACE_HINT)


def name_key(name: Column, fold: bool = True) -> Column:
    """Key of a place name: folded, street and city prefixes dropped, words joined.

    `fold=False` lower-cases inside the JVM, which is the same for names in composed form without sharp s and the like.
    """
    # Prefixes of streets and towns.
    out = F.replace(folded(name) if fold else F.lower(name), F.lit("ѝ"), F.lit("и"))
    out = F.regexp_replace(out, r"(?U)\b(?:улица|ул|булевард|бул|град|гр)\b\.?\s*", " ")
    return F.array_join(F.regexp_extract_all(out, F.lit(r"(?U)(\w+)"), 1), " ")


# Parsers of advertisement pages


def nullable(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def external_id(url: Column) -> Column:
    """The id in the path, or the last path segment."""
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/", -1), -1)
    return F.coalesce(nullable(F.regexp_extract(url, "/obiava-([a-z0-9]+)", 1)), last)


def price(raw: Column) -> Column:
    """Struct of amount and currency; null without a digit.  Digits are joined whatever stands between them."""
    digits = F.regexp_replace(raw, r"(?U)[^\d]", "")
    currency = F.when(F.contains(raw, F.lit("€")), "EUR").otherwise("BGN")
    return F.when(digits != "", F.struct(digits.cast("double").alias("amount"), currency.alias("currency")))


def first_number(raw: Column) -> Column:
    """The first number, with decimal comma or point."""
    return F.replace(nullable(F.regexp_extract(raw, r"\d+(?:[.,]\d+)?", 0)), F.lit(","), F.lit(".")).try_cast("double")


def location(raw: Column) -> Column:
    """Struct of city, area and street from the lines of a location block."""
    lines = F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")

    def parts(x: Column) -> Column:
        head = F.coalesce(F.get(x, F.lit(0)), F.lit(""))
        # Prefixes of towns and villages.
        city = F.trim(F.regexp_replace(F.trim(F.substring_index(head, ",", 1)), r"(?U)^(?:град|гр\.|село|с\.)\s+", ""))
        comma = F.instr(head, ",")
        area = F.when(comma > 0, F.trim(F.substring(head, comma + 1, F.length(head)))).otherwise("")
        return F.struct(city.alias("city"), area.alias("area"), F.get(x, F.lit(1)).alias("street"))

    return once(lines, parts)


def transaction_type(title: Column) -> Column:
    """sale or rent by title; null where neither phrase occurs (the caller reports those rows)."""
    flat = F.lower(squeezed(title))
    return F.when(F.contains(flat, F.lit("продава")), "sale").when(F.contains(flat, F.lit("дава под наем")), "rent")


def rooms(title: Column) -> Column:
    return nullable(F.regexp_extract(title, r"(?iU)\b(\d+)-СТАЕН\b", 1)).try_cast("int")


def floor(raw: Column) -> Column:
    return nullable(F.regexp_extract(raw, r"\d+", 0)).try_cast("int")


def building_floors(raw: Column) -> Column:
    return nullable(F.regexp_extract(raw, r"(?iU)\bот\s+(\d+)\b", 1)).try_cast("int")


def phone(raw: Column) -> Column:
    return nullable(F.regexp_replace(raw, r"(?U)\s+", ""))


def parameters(rows: Column) -> Column:
    """label: value rows as a map; the first value of a label stays, rows without a label go."""
    pairs = F.filter(rows, lambda r: F.contains(r, F.lit(":")))
    entries = F.filter(F.transform(pairs, lambda r: F.struct(F.regexp_replace(F.substring_index(r, ":", 1), r"(?U)^\s+|\s+$", "").alias("key"), squeezed(F.substring(r, F.instr(r, ":") + 1, F.length(r))).alias("value"))), lambda e: e["key"] != "")
    first = once(entries, lambda e: F.filter(e, lambda x, i: F.array_position(F.transform(e, lambda y: y["key"]), x["key"]) == i + 1))
    return F.map_from_entries(first)


def image_urls(sources: Column, base: str = "https://www.imot.bg") -> Column:
    """Absolute, distinct image addresses in gallery order; placeholders go."""
    real = F.filter(sources, lambda s: s.isNotNull() & (s != "") & ~F.startswith(s, F.lit("data:")))
    scheme = base.split("//")[0]
    return F.array_distinct(F.transform(real, lambda s: F.when(F.startswith(s, F.lit("//")), F.concat(F.lit(scheme), s)).when(s.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), s).when(F.startswith(s, F.lit("/")), F.concat(F.lit(base), s)).otherwise(F.concat(F.lit(base + "/"), s))))


def last_page(pager: Column) -> Column:
    return F.greatest(F.coalesce(nullable(F.regexp_extract(pager, r"\d+", 0)).try_cast("int"), F.lit(1)), F.lit(1))


def page_url(url: Column, page: Column) -> Column:
    """`/p-N` after the path, the query kept; page 1 is the address itself."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    rest = F.substring(url, F.length(path) + 1, F.length(url))
    return F.when(page == 1, url).otherwise(F.concat(F.regexp_replace(path, "/+$", ""), F.lit("/p-"), page.cast("string"), rest))


def missing_fields(**fields: Column) -> Column:
    """Names of the fields that are null, empty or an empty array, in the order given."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in fields.items()]))


def removal_notice(body: Column, has_title: Column) -> Column:
    """A page without a title on which one line is just a removal notice."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(F.lower(squeezed(x)), "[.! ]+$", ""))
    return ~has_title & F.arrays_overlap(lines, F.array(*map(F.lit, REMOVAL_NOTICES)))


def removal_redirect(requested: Column, final: Column) -> Column:
    """A listing address that ended on the sales search pages."""
    asked, got = (lambda part: F.try_parse_url(requested, F.lit(part))), (lambda part: F.try_parse_url(final, F.lit(part)))
    sales = "/obiavi/prodazhbi"
    return F.coalesce(
        F.lower(asked("HOST")).isin(*SEARCH_HOSTS) & F.startswith(asked("PATH"), F.lit("/obiava-")) & got("PROTOCOL").isin("http", "https") & F.lower(got("HOST")).isin(*SEARCH_HOSTS) & ((got("PATH") == sales) | F.startswith(got("PATH"), F.lit(sales + "/"))),
        F.lit(False),
    )


def search_scope(url: Column, slugs: dict[str, int]) -> Column:
    """Struct of area slugs and rooms from a search address; `slugs` maps room slugs to numbers of rooms.

    The segment before the first room slug is the area if at least four segments come before the slug.
    """
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    parts = F.transform(F.filter(F.split(path, "/", -1), lambda p: (p != "") & ~p.rlike(r"^p-\d+$")), lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    table = F.create_map(*[x for k, v in slugs.items() for x in (F.lit(k), F.lit(v))])

    def scope(p: Column) -> Column:
        numbers = F.transform(p, lambda x: F.try_element_at(table, x))
        at = F.array_position(F.transform(numbers, lambda n: n.isNotNull()), True)
        area = F.when(at >= 5, F.array(F.get(p, (at - 2).cast("int")))).otherwise(F.array().cast("array<string>"))
        return F.struct(area.alias("area_slugs"), F.array_sort(F.array_distinct(F.array_compact(numbers))).alias("rooms"))

    return once(parts, scope)


def http_outcome(status: Column) -> Column:
    """unavailable for 404 and 410, transient for other errors and for no response, else ok."""
    return F.when(status.isNull(), "transient").when(status.isin(404, 410), "unavailable").when(status >= 400, "transient").otherwise("ok")


def safe_link(url: Column) -> Column:
    """The address if it is http or https with a host and without credentials, else null."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    return F.when(part("PROTOCOL").isin("http", "https") & (part("HOST") != "") & part("USERINFO").isNull(), url)


def image_kind(url: Column) -> Column:
    """Struct of extension and content type guessed from an image address; the first known extension in it, else .jpg."""
    # Extensions in the order they are looked for, with their types.
    kinds = ((".jpg", "image/jpeg"), (".jpeg", "image/jpeg"), (".png", "image/png"), (".webp", "image/webp"))
    extension, content = F.lit(".jpg"), F.lit("image/jpeg")
    for name, kind in reversed(kinds):
        here = F.contains(F.lower(url), F.lit(name))
        extension, content = F.when(here, name).otherwise(extension), F.when(here, kind).otherwise(content)
    return F.struct(extension.alias("extension"), content.alias("content_type"))


def approved_source(url: Column, hosts: tuple[str, ...]) -> Column:
    """https on the standard port, a listed host, no credentials."""
    part = lambda name: F.try_parse_url(url, F.lit(name))
    plain = F.coalesce(F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1).isin("", "443"), F.lit(False))
    return F.coalesce((part("PROTOCOL") == "https") & part("HOST").isin(*hosts) & part("USERINFO").isNull() & plain, F.lit(False))


def user_prompt(title: Column, city: Column, area: Column, description: Column) -> Column:
    """The user turn of a labelling request."""
    return F.concat(F.lit("<ad>\n"), title, F.lit("\nРайон: "), city, F.lit(", "), area, F.lit("\n\n"), description, F.lit("\n</ad>"))


def without_tags(html: Column) -> Column:
    """Text of a piece of HTML on one line."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return squeezed(text)


def listing_cards(html: Column, base: str = "https://www.imot.bg") -> Column:
    """Array of struct<url, title, price, external_id, kind> from a page of search results; cards without a link are skipped."""
    pieces = F.split(html, r'(?i)<div[^>]*class="(?:[^"]*\s)?item(?:\s[^"]*)?"[^>]*>', -1)
    cards = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    link = r'(?is)<a(?=[^>]*class="[^"]*\bsaveSlink\b)[^>]*>(.*?)</a>'

    def card(c: Column) -> Column:
        href = F.regexp_extract(F.regexp_extract(c, link, 0), r'(?i)href="([^"]*)"', 1)
        absolute = F.get(image_urls(F.array(href), base), F.lit(0))
        title = without_tags(F.regexp_extract(c, link, 1))
        cost = without_tags(F.regexp_extract(c, r'(?is)<div[^>]*class="[^"]*\bprice\b[^"]*"[^>]*>(.*?)</div>', 1))
        return F.struct(absolute.alias("url"), title.alias("title"), price(cost).alias("price"), external_id(absolute).alias("external_id"), transaction_type(title).alias("kind"))

    return F.filter(F.transform(cards, card), lambda c: c["url"].isNotNull())


def listing_page(html: Column) -> Column:
    """Struct of the fields of an advertisement page, raw texts parsed; `missing` names core fields that were not found."""
    block = lambda name: F.regexp_extract(html, rf'(?is)<div[^>]*class="(?:[^"]*\s)?{name}(?:\s[^"]*)?"[^>]*>(.*?)</div>', 1)
    lines = F.regexp_replace(F.regexp_replace(block("location"), r"(?i)<br[^>]*>|</span>", "\n"), "<[^>]*>", "")
    rows = F.transform(F.regexp_extract_all(F.regexp_extract(html, r'(?is)<div[^>]*class="adParams"[^>]*>(.*?)</section>|<div[^>]*class="adParams"[^>]*>(.*)', 0), F.lit(r"(?is)<div[^>]*>([^<]*:.*?)</div>"), 1), without_tags)
    images = image_urls(F.regexp_extract_all(html, F.lit(r'(?is)<img[^>]*\sdata-src="([^"]*)"'), 1))
    title, cost, place = without_tags(block("title")), price(without_tags(block("cena"))), location(lines)
    grid = parameters(rows)
    # Labels of the grid.
    area, level = F.try_element_at(grid, F.lit("Площ")), F.try_element_at(grid, F.lit("Етаж"))
    size = first_number(area)
    return F.struct(
        title.alias("title"), cost.alias("price"), transaction_type(title).alias("kind"), rooms(title).alias("rooms"), place["city"].alias("city"), place["area"].alias("area"), place["street"].alias("street"),
        without_tags(block("text")).alias("description"), phone(without_tags(block("phone"))).alias("phone"), size.alias("area_sqm"), floor(level).alias("floor"), building_floors(level).alias("building_floors"), images.alias("image_urls"),
        missing_fields(title=title == "", price=cost.isNull(), area_sqm=F.coalesce(size, F.lit(0.0)) == 0, city=place["city"] == "", images=F.size(images) == 0).alias("missing"),
    )


def street_address(name: Column) -> Column:
    """Struct of street and number, or null: a name that ends in a house number."""
    # Words for a house number.
    pattern = r"(?iU)^(.+?)\s*(?:№|номер|No\.?|N)?\s+(\d+[а-яa-z]?)\s*$"
    number = F.regexp_extract(name, pattern, 2)
    return F.when(number != "", F.struct(F.regexp_extract(name, pattern, 1).alias("street"), number.alias("number")))


def excluded_context(text: Column, start: Column, end: Column) -> Column:
    """Negations, comparisons and the agency's own address around a mention (70 characters before, 30 after)."""
    # Phrases that turn a mention into none.
    phrases = r"(?U)(?:не\s+е\s+(?:до|близо)|далеч\s+от|без\s+достъп|нашият\s+офис|офисът\s+ни|агенцията\s+се\s+намира|за\s+разлика\s+от)"
    begin = F.greatest(start - 70, F.lit(0))
    return F.lower(F.substring(text, begin + 1, end + 30 - begin)).rlike(phrases)


def attached_radius(text: Column, start: Column, end: Column) -> Column:
    """Struct<radius, note> from a distance that is attached to the mention itself.

    One distance: 1.5 times its metres, 100 at least; null radius (omit) when not positive or over 3000.  Two: broad support
    of 500 and a note.  None: 500.
    """
    # Units and joining words of distances.
    amount = r"(\d{1,4}(?:[.,]\d+)?)\s*(км|метра|метри|м)\b"
    before = r"(?iU)" + amount + r"\s*(?:пеша\s*)?(?:от|до)?\s*[„“\"]?$"
    after = r"(?iU)^[“\"]?\s*(?:е\s+)?(?:на|[-–—:])\s*" + amount
    begin = F.greatest(start - 60, F.lit(0))
    prefix, suffix = F.substring(text, begin + 1, start - begin), F.substring(text, end + 1, 45)

    def metres(source: Column, pattern: str) -> Column:
        value = F.replace(nullable(F.regexp_extract(source, pattern, 1)), F.lit(","), F.lit(".")).try_cast("double")
        return value * F.when(F.lower(F.regexp_extract(source, pattern, 2)) == "км", 1000.0).otherwise(1.0)

    one, two = metres(prefix, before), metres(suffix, after)
    single = F.coalesce(one, two)
    radius = F.when(one.isNotNull() & two.isNotNull(), F.lit(500.0)).when(single.isNull(), F.lit(500.0)).when((single > 0) & (single * 1.5 <= 3000), F.greatest(F.lit(100.0), single * 1.5))
    note = F.when(one.isNotNull() & two.isNotNull(), "ambiguous").when(radius.isNull(), "omitted")
    return F.struct(radius.alias("radius"), note.alias("note"))
