"""Advertisement pages made up from parts and suppliers, parsed back into fields.

The pages are built from columns by a formula; the SQL states what each formula must be read as, so every parser is held
against values that it does not see.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.plans.tables import read

def key():
    return F.col("p_partkey")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _parts(spark, d):
    return read(spark, d, "part")


def listing_cards(spark, d):
    """Two cards and one without a link on each page."""
    card = lambda n, kind: _text('<div class="x item"><a href="//www.imot.bg/obiava-', key(), f'x{n}" class="saveSlink wide">', kind, " <b>", key() % 4 + 1, '-СТАЕН</b></a><div class="price">', F.col("p_size"), f" {n}00 &euro;", F.when(key() % 2 == 0, " €").otherwise(""), "</div></div>")
    html = F.concat(F.lit("<html><body>"), card(1, "Продава"), F.lit('<div class="item"><p>реклама</p></div>'), card(2, "Дава под наем"), F.lit("</body></html>"))
    each = _parts(spark, d).select("p_partkey", F.posexplode(T.listing_cards(html)).alias("pos", "c"))
    return each.select("p_partkey", F.col("pos").cast("long").alias("pos"), "c.url", "c.title", F.col("c.price.amount").alias("amount"), F.col("c.price.currency").alias("currency"), "c.external_id", "c.kind")


def listing_page(spark, d):
    """Whole pages; every fifth lacks a price, every seventh its images."""
    html = _text(
        '<div class="title big">Продава ', key() % 5 + 1, '-СТАЕН апартамент</div><div class="cena">', F.when(key() % 5 != 0, _text(F.col("p_size"), " 000 €")).otherwise("по договаряне"),
        '</div><div class="location">град София, Район ', key() % 9, '<br>ул. Оборище</div><div class="text">Текст <i>', key(), '</i> &amp; още</div><div class="phone">0888 ', key() % 1000, ' 1</div><div class="adParams"><div>Площ: <b>',
        F.col("p_size"), ",5 кв.м</b></div><div>Етаж: ", key() % 8, " от ", key() % 8 + 2, "</div><div>Площ: 1 кв.м</div></section>", F.when(key() % 7 != 0, _text('<img alt="" data-src="//cdn.imot.bg/', key(), '.jpg"><img x="1" data-src="/a.png">')).otherwise(""),
    )
    page = _parts(spark, d).select("p_partkey", T.listing_page(html).alias("l"))
    return page.select("p_partkey", "l.title", F.col("l.price.amount").alias("amount"), "l.kind", F.col("l.rooms").cast("long").alias("rooms"), "l.city", "l.area", "l.street", "l.description", "l.phone", "l.area_sqm", F.col("l.floor").cast("long").alias("floor"), F.col("l.building_floors").cast("long").alias("building_floors"), F.array_join("l.image_urls", " ").alias("images"), F.array_join("l.missing", " ").alias("missing"))


def location_split(spark, d):
    raw = F.when(key() % 3 == 0, _text("  гр. София , Младост ", key(), ", Юг \n  ул. ", F.col("p_name"), "  \n")).when(key() % 3 == 1, _text("село ", F.col("p_name"), "\r\n\n")).otherwise(F.lit(None))
    place = _parts(spark, d).select("p_partkey", T.location(raw).alias("p"))
    return place.select("p_partkey", "p.city", "p.area", "p.street")


def phones_and_numbers(spark, d):
    raw = F.when(key() % 4 == 0, F.lit(" \t ")).otherwise(_text(" 08", key() % 10, "\t", key(), " 77\n"))
    number = F.when(key() % 4 == 1, F.lit("без")).otherwise(_text("около ", F.col("p_size"), F.when(key() % 2 == 0, ",25").otherwise(".5"), " или ", key()))
    return _parts(spark, d).select("p_partkey", T.phone(raw).alias("phone"), T.first_number(number).alias("number"))


def parameters(spark, d):
    """Rows of a grid; the second value of a label and rows without a label are ignored."""
    rows = F.array(_text("Площ : ", F.col("p_size"), "  кв.м"), F.lit("без двоеточие"), _text("Етаж:", key() % 9, ":от 9"), F.lit(": сам"), _text("Площ: ", key()))
    grid = _parts(spark, d).select("p_partkey", T.parameters(rows).alias("g"))
    return grid.select("p_partkey", F.size("g").cast("long").alias("n"), F.try_element_at("g", F.lit("Площ")).alias("area"), F.try_element_at("g", F.lit("Етаж")).alias("floor"))


def image_urls(spark, d):
    sources = F.array(_text("//cdn.x.bg/", key() % 7, ".jpg"), F.lit("data:image/png;base64,AA"), F.lit(""), _text("/big/", key(), ".webp"), F.lit(None).cast("string"), _text("//cdn.x.bg/", key() % 7, ".jpg"), _text("http://o.org/", key(), ".PNG?x=.gif"), _text("rel/", key()))
    found = _parts(spark, d).select("p_partkey", F.posexplode(T.image_urls(sources)).alias("pos", "url"))
    return found.select("p_partkey", F.col("pos").cast("long").alias("pos"), "url", T.image_kind(F.col("url"))["extension"].alias("extension"), T.image_kind(F.col("url"))["content_type"].alias("content_type"))


def search_scope(spark, d):
    slugs = {"ednostaen": 1, "dvustaen": 2, "tristaen": 3}
    room = F.element_at(F.array(F.lit("dvustaen"), F.lit("tristaen"), F.lit("garazh")), (key() % 3 + 1).cast("int"))
    url = F.when(key() % 2 == 0, _text("https://www.imot.bg/obiavi/prodazhbi/grad-sofia/a", key() % 11, "%20b/", room, "/ednostaen/p-3?x=1")).otherwise(_text("https://www.imot.bg/obiavi/", room))
    scope = _parts(spark, d).select("p_partkey", T.search_scope(url, slugs).alias("s"))
    return scope.select("p_partkey", F.array_join("s.area_slugs", ",").alias("areas"), F.array_join(F.transform("s.rooms", lambda r: r.cast("string")), ",").alias("rooms"))


def removals(spark, d):
    """Redirects to the search pages, notices on pages without a title, and states of answers."""
    final = F.element_at(F.array(F.lit("https://imot.bg/obiavi/prodazhbi/grad-sofia"), F.lit("https://www.imot.bg/obiavi/prodazhbishte"), F.lit("https://example.org/obiavi/prodazhbi"), F.lit("http://WWW.imot.bg/obiavi/prodazhbi")), (key() % 4 + 1).cast("int"))
    asked = F.when(key() % 5 == 0, F.lit("https://www.imot.bg/kvartali")).otherwise(_text("https://www.imot.bg/obiava-", key()))
    body = F.when(key() % 3 == 0, F.lit("Начало\n Обявата  е ИЗТРИТА!. \nкрай")).otherwise(F.lit("Обявата е изтрита от автора"))
    status = F.element_at(F.array(F.lit(200), F.lit(301), F.lit(404), F.lit(410), F.lit(403), F.lit(500), F.lit(None).cast("int")), (key() % 7 + 1).cast("int"))
    return _parts(spark, d).select("p_partkey", T.removal_redirect(asked, final).alias("redirected"), T.removal_notice(body, key() % 2 == 0).alias("noticed"), T.http_outcome(status).alias("outcome"))


def pagers(spark, d):
    pager = F.when(key() % 5 == 0, F.lit("няма")).otherwise(_text("Страница 1 от ", key() % 30))
    last = F.regexp_extract(pager, r"\d+$", 0)
    return _parts(spark, d).select("p_partkey", T.last_page(last).cast("long").alias("last"), T.page_url(_text("https://x.bg/a/?q=", key(), "#f"), (key() % 3 + 1).cast("int")).alias("url"))


def missing_fields(spark, d):
    """Core fields that a parsed listing lacks."""
    rows = _parts(spark, d).select("p_partkey", F.when(key() % 2 == 0, F.col("p_name")).otherwise("").alias("title"), F.when(key() % 3 != 0, F.col("p_retailprice")).alias("price"), F.array_repeat(F.lit("i"), (key() % 4).cast("int")).alias("images"))
    found = T.missing_fields(title=F.col("title") == "", price=F.col("price").isNull(), images=F.size("images") == 0)
    return rows.select("p_partkey", F.array_join(found, ",").alias("missing"), (F.coalesce("price", F.lit(0.0)) >= 0).alias("money_ok"))


def street_addresses(spark, d):
    mark = F.element_at(F.array(F.lit(" № "), F.lit(" номер "), F.lit(" No. "), F.lit(" ")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    name = F.when(F.col("s_suppkey") % 9 == 8, F.lit("площад без номер")).otherwise(_text("Граф ", F.col("s_nationkey"), " Улица", mark, F.col("s_suppkey") + 1, F.when(F.col("s_suppkey") % 2 == 0, "а").otherwise("")))
    found = read(spark, d, "supplier").select("s_suppkey", T.street_address(name).alias("a"))
    return found.select("s_suppkey", "a.street", "a.number")


def name_keys(spark, d):
    """Folded keys: prefixes dropped, compatibility forms composed, cases folded."""
    name = _text("бул. ", F.initcap("p_name"), F.when(key() % 2 == 0, "  ѝ ГР. Ｗ").otherwise(" Straße-12"))
    return _parts(spark, d).select("p_partkey", T.name_key(name).alias("key"))


def attached_distances(spark, d):
    """A distance before, after, on both sides, none, and one that is too far."""
    n = key() % 90 + 1
    case = (key() % 5).cast("int")
    before = F.element_at(F.array(_text("Само ", n, " м до "), F.lit("Хубав "), _text("На ", n, " км от "), F.lit("До "), _text("На ", n * 100, " метра от ")), case + 1)
    after = F.element_at(F.array(F.lit(" е тук"), _text(" е на ", n, " метра"), F.lit(" и край"), F.lit(" без число"), _text(" - ", n, " м")), case + 1)
    text = F.concat(before, F.lit("Южен парк"), after)
    start = F.length(before)
    radius = T.attached_radius(text, start, start + 9)
    return _parts(spark, d).select("p_partkey", radius["radius"].alias("radius"), radius["note"].alias("note"))


def excluded_contexts(spark, d):
    pad = F.repeat(F.lit("x"), (key() % 90).cast("int"))
    phrase = F.element_at(F.array(F.lit("не е  близо до"), F.lit("Далеч от"), F.lit("близо до")), (key() % 3 + 1).cast("int"))
    before = F.concat(phrase, F.lit(" "), pad, F.lit(" "))
    text = F.concat(before, F.lit("метро"), F.when(key() % 10 == 0, " и нашият офис").otherwise(""))
    return _parts(spark, d).select("p_partkey", T.excluded_context(text, F.length(before), F.length(before) + 5).alias("excluded"))


def prompts_and_sources(spark, d):
    """User turns of labelling requests, links that may be shown, and addresses that may be downloaded."""
    url = F.element_at(F.array(F.lit("https://gis.sofiaplan.bg/a?b=1"), F.lit("http://gis.sofiaplan.bg/a"), F.lit("https://gis.sofiaplan.bg:8443/a"), F.lit("https://u:p@gis.sofiaplan.bg/a"), F.lit("https://gis.sofiaplan.bg:443/a"), F.lit("ftp://gis.sofiaplan.bg"), F.lit("https://evil.org/gis.sofiaplan.bg")), (key() % 7 + 1).cast("int"))
    return _parts(spark, d).select("p_partkey", T.user_prompt(F.col("p_name"), F.lit("София"), F.col("p_brand"), F.col("p_type")).alias("prompt"), T.approved_source(url, ("gis.sofiaplan.bg",)).alias("approved"), T.safe_link(url).alias("link"))


QUERIES = {
    "q_listing_cards": listing_cards, "q_listing_page": listing_page, "q_location_split": location_split, "q_phone_numbers": phones_and_numbers, "q_parameter_grid": parameters, "q_image_urls": image_urls,
    "q_search_scope": search_scope, "q_removals": removals, "q_pagers": pagers, "q_missing_fields": missing_fields, "q_street_address": street_addresses, "q_name_key": name_keys,
    "q_attached_distance": attached_distances, "q_excluded_context": excluded_contexts, "q_prompts_and_sources": prompts_and_sources,
}

ORACLE_SQL = {
    "q_listing_cards": """SELECT p_partkey, n - 1 AS pos, 'https://www.imot.bg/obiava-' || p_partkey || 'x' || n AS url, CASE n WHEN 1 THEN 'Продава ' ELSE 'Дава под наем ' END || (p_partkey % 4 + 1) || '-СТАЕН' AS title,
(p_size * 1000 + n * 100)::DOUBLE AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'BGN' END AS currency, p_partkey || 'x' || n AS external_id, CASE n WHEN 1 THEN 'sale' ELSE 'rent' END AS kind FROM part, range(1, 3) r(n)""",
    "q_listing_page": """SELECT p_partkey, 'Продава ' || (p_partkey % 5 + 1) || '-СТАЕН апартамент' AS title, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 1000.0 END::DOUBLE AS amount, 'sale' AS kind, p_partkey % 5 + 1 AS rooms, 'София' AS city, 'Район ' || p_partkey % 9 AS area, 'ул. Оборище' AS street,
'Текст ' || p_partkey || ' & още' AS description, '0888' || p_partkey % 1000 || '1' AS phone, p_size + 0.5::DOUBLE AS area_sqm, p_partkey % 8 AS floor, p_partkey % 8 + 2 AS building_floors,
CASE WHEN p_partkey % 7 <> 0 THEN 'https://cdn.imot.bg/' || p_partkey || '.jpg https://www.imot.bg/a.png' ELSE '' END AS images, concat_ws(' ', CASE WHEN p_partkey % 5 = 0 THEN 'price' END, CASE WHEN p_partkey % 7 = 0 THEN 'images' END) AS missing FROM part""",
    "q_location_split": """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'София' WHEN 1 THEN p_name ELSE '' END AS city, CASE p_partkey % 3 WHEN 0 THEN 'Младост ' || p_partkey || ', Юг' ELSE '' END AS area, CASE p_partkey % 3 WHEN 0 THEN 'ул. ' || p_name END AS street FROM part""",
    "q_phone_numbers": """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN '08' || p_partkey % 10 || p_partkey || '77' END AS phone, CASE WHEN p_partkey % 4 <> 1 THEN p_size + CASE WHEN p_partkey % 2 = 0 THEN 0.25 ELSE 0.5 END END::DOUBLE AS number FROM part""",
    "q_parameter_grid": "SELECT p_partkey, 2::BIGINT AS n, p_size || ' кв.м' AS area, p_partkey % 9 || ':от 9' AS floor FROM part",
    "q_image_urls": """WITH u AS (SELECT p_partkey, unnest([0, 1, 2, 3])::BIGINT AS pos, unnest(['https://cdn.x.bg/' || p_partkey % 7 || '.jpg', 'https://www.imot.bg/big/' || p_partkey || '.webp', 'http://o.org/' || p_partkey || '.PNG?x=.gif', 'https://www.imot.bg/rel/' || p_partkey]) AS url FROM part)
SELECT *, CASE pos WHEN 1 THEN '.webp' WHEN 2 THEN '.png' ELSE '.jpg' END AS extension, CASE pos WHEN 1 THEN 'image/webp' WHEN 2 THEN 'image/png' ELSE 'image/jpeg' END AS content_type FROM u""",
    "q_search_scope": """SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN '' WHEN p_partkey % 3 = 2 THEN 'garazh' ELSE 'a' || p_partkey % 11 || ' b' END AS areas,
CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN '1,2' WHEN 1 THEN '1,3' ELSE '1' END ELSE CASE p_partkey % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '' END END AS rooms FROM part""",
    "q_removals": """SELECT p_partkey, p_partkey % 5 <> 0 AND p_partkey % 4 IN (0, 3) AS redirected, p_partkey % 2 = 1 AND p_partkey % 3 = 0 AS noticed,
CASE WHEN p_partkey % 7 IN (0, 1) THEN 'ok' WHEN p_partkey % 7 IN (2, 3) THEN 'unavailable' ELSE 'transient' END AS outcome FROM part""",
    "q_pagers": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE greatest(1, p_partkey % 30) END::BIGINT AS last, CASE p_partkey % 3 WHEN 0 THEN 'https://x.bg/a/' ELSE 'https://x.bg/a/p-' || (p_partkey % 3 + 1) END || '?q=' || p_partkey || '#f' AS url FROM part",
    "q_missing_fields": "SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 1 OR p_name = '' THEN 'title' END, CASE WHEN p_partkey % 3 = 0 THEN 'price' END, CASE WHEN p_partkey % 4 = 0 THEN 'images' END) AS missing, p_partkey % 3 = 0 OR p_retailprice >= 0 AS money_ok FROM part",
    "q_street_address": "SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 8 THEN 'Граф ' || s_nationkey || ' Улица' END AS street, CASE WHEN s_suppkey % 9 <> 8 THEN (s_suppkey + 1) || CASE WHEN s_suppkey % 2 = 0 THEN 'а' ELSE '' END END AS number FROM supplier",
    "q_name_key": r"SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[\p{L}\p{N}_]+'), ' ') || CASE WHEN p_partkey % 2 = 0 THEN ' и w' ELSE ' strasse 12' END AS key FROM part",
    "q_attached_distance": """WITH c AS (SELECT p_partkey, p_partkey % 90 + 1 AS n, p_partkey % 5 AS k FROM part), v AS (SELECT *, CASE k WHEN 0 THEN n WHEN 1 THEN n WHEN 2 THEN n * 1000 END AS m FROM c)
SELECT p_partkey, CASE WHEN k IN (3, 4) THEN 500 WHEN m * 1.5 <= 3000 THEN greatest(100, m * 1.5) END::DOUBLE AS radius, CASE WHEN k = 4 THEN 'ambiguous' WHEN k = 2 AND m * 1.5 > 3000 THEN 'omitted' END AS note FROM v""",
    "q_excluded_context": """SELECT p_partkey, p_partkey % 10 = 0 OR CASE p_partkey % 3 WHEN 0 THEN length('не е  близо до') + 2 + p_partkey % 90 <= 70 WHEN 1 THEN length('далеч от') + 2 + p_partkey % 90 <= 70 ELSE false END AS excluded FROM part""",
    "q_prompts_and_sources": """WITH u AS (SELECT *, ['https://gis.sofiaplan.bg/a?b=1', 'http://gis.sofiaplan.bg/a', 'https://gis.sofiaplan.bg:8443/a', 'https://u:p@gis.sofiaplan.bg/a', 'https://gis.sofiaplan.bg:443/a', 'ftp://gis.sofiaplan.bg', 'https://evil.org/gis.sofiaplan.bg'][p_partkey % 7 + 1] AS url FROM part)
SELECT p_partkey, '<ad>' || chr(10) || p_name || chr(10) || 'Район: София, ' || p_brand || chr(10) || chr(10) || p_type || chr(10) || '</ad>' AS prompt, p_partkey % 7 IN (0, 4) AS approved, CASE WHEN p_partkey % 7 NOT IN (3, 5) THEN url END AS link FROM u""",
}
