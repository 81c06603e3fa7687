"""Parsers, cleaning and hashing of advertisement text."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("r")).first()["r"]


@pytest.mark.parametrize("raw,want", [("Тел. 0887-88-99-98 до парка", "Тел. до парка"), ("пиши на a.b+c@mail.example.bg сега", "пиши на сега"), ("виж https://x.bg/a?b=1 тук", "виж тук"), ("цена 229 000 лв., 2008 г.", "цена 229 000 лв., 2008 г."), ("реф. номер: 2116090 край", "край"), ("📞 +359 88 123 4567\nЮжен парк", "Южен парк"), ("а​б в", "аб в"), ("a\r\n\r\n\r\n\r\nb\r c", "a\n\nb\nc"), ("!!!\n✓ Отлична", "✓ Отлична"), (None, ""), ("", ""), ("café", "café")])
def test_clean_description(spark, raw, want):
    assert one(spark, raw, T.clean_description) == want


def test_cleaning_without_composition_is_the_same_for_composed_text(spark):
    assert one(spark, "Тел. 0887 889 998\n\n\n\nВиж", lambda c: T.clean_description(c, compose=False)) == "Тел.\n\nВиж"


def test_hashes_differ_in_what_they_ignore(spark):
    text = "  До Южен \n ПАРК! 10_x "
    assert one(spark, text, T.exact_hash) == hashlib.sha256(text.encode()).hexdigest()
    assert one(spark, text, T.spaced_hash) == hashlib.sha256("До Южен ПАРК! 10_x".encode()).hexdigest()
    assert one(spark, text, T.word_hash) == hashlib.sha256("до южен парк 10 x".encode()).hexdigest()


@pytest.mark.parametrize("text,want", [("a b c d", ["a b c", "b c d"]), ("A, b", ["a b"]), ("", []), (None, []), ("x x x x", ["x x x"])])
def test_shingles(spark, text, want):
    assert one(spark, text, T.shingles) == want


@pytest.mark.parametrize("value,want", [("Южен парк", "yuzhen-park"), ("Щъркелово  гнездо", "shtarkelovo-gnezdo"), ("Ж.К. Ценко", "zh.k.-tsenko"), ("Чай", "chay"), ("боксьор", "boksor")])
def test_slug(spark, value, want):
    assert one(spark, value, T.slug) == want


@pytest.mark.parametrize("name,want", [("бул. Витоша", "витоша"), ("Улица  Иван-Вазов", "иван вазов"), ("33 СУ „Св. София“", "33 су св софия"), ("STRASSE ß", "strasse ss"), ("гр. София", "софия")])
def test_name_key(spark, name, want):
    assert one(spark, name, T.name_key) == want


@pytest.mark.parametrize("raw,want", [("150 000 €", (150000.0, "EUR")), ("700 лв.", (700.0, "BGN")), ("Цена при запитване", None), ("", None)])
def test_price(spark, raw, want):
    got = one(spark, raw, T.price)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize("raw,want", [("85 кв.м", 85.0), ("85,5 кв.м", 85.5), ("от 12.75", 12.75), ("няма", None), ("", None)])
def test_first_number(spark, raw, want):
    assert one(spark, raw, T.first_number) == want


@pytest.mark.parametrize("raw,want", [("град София, Лозенец\nул. Бяла 5", ("София", "Лозенец", "ул. Бяла 5")), ("с. Бистрица", ("Бистрица", "", None)), ("гр. Бургас, Меден рудник, зона Б\n\n", ("Бургас", "Меден рудник, зона Б", None)), ("", ("", "", None)), ("градина, х", ("градина", "х", None))])
def test_location(spark, raw, want):
    assert tuple(one(spark, raw, T.location)) == want


def test_titles_and_floors(spark):
    assert one(spark, "Продава  3-СТАЕН, София", T.transaction_type) == "sale"
    assert one(spark, "Дава под   наем 2-стаен", T.transaction_type) == "rent"
    assert one(spark, "Търси квартира", T.transaction_type) is None
    assert one(spark, "Дава под наем 2-стаен", T.rooms) == 2 and one(spark, "МЕЗОНЕТ", T.rooms) is None
    assert one(spark, "5-ти от 8", T.floor) == 5 and one(spark, "5-ти от 8", T.building_floors) == 8
    assert one(spark, "партер", T.floor) is None and one(spark, " 0888 12 34 ", T.phone) == "08881234" and one(spark, "  ", T.phone) is None


def test_addresses_of_pages(spark):
    assert one(spark, "https://www.imot.bg/obiava-1b17-prodava", T.external_id) == "1b17"
    assert one(spark, "https://x.bg/a/b/", T.external_id) == "b"
    assert one(spark, "https://x.bg/s/?q=1", lambda c: T.page_url(c, F.lit(3))) == "https://x.bg/s/p-3?q=1"
    assert one(spark, "https://x.bg/s?q=1", lambda c: T.page_url(c, F.lit(1))) == "https://x.bg/s?q=1"
    assert one(spark, "1 2 … 17", T.last_page) == 1 and one(spark, "няма", T.last_page) == 1
    assert one(spark, "http://u:p@x.bg/", T.safe_link) is None and one(spark, "javascript:x", T.safe_link) is None and one(spark, "https://x.bg/", T.safe_link) == "https://x.bg/"
    scope = one(spark, "https://www.imot.bg/obiavi/prodazhbi/grad/sofiya/lozenets/dvustaen/p-2", lambda c: T.search_scope(c, {"dvustaen": 2}))
    assert (scope["area_slugs"], scope["rooms"]) == (["lozenets"], [2])
    assert one(spark, 404, T.http_outcome, "int") == "unavailable" and one(spark, 500, T.http_outcome, "int") == "transient" and one(spark, 200, T.http_outcome, "int") == "ok"


def test_grid_and_images(spark):
    grid = one(spark, ["Площ:\n 85 кв.м", "Етаж: 3", "Площ: 90", "без етикет", ": x"], T.parameters, "array<string>")
    assert grid == {"Площ": "85 кв.м", "Етаж": "3"}
    assert one(spark, ["//cdn.x/1.jpg", None, "data:image/x", "/2.png", "//cdn.x/1.jpg", "https://y/3.webp"], T.image_urls, "array<string>") == ["https://cdn.x/1.jpg", "https://www.imot.bg/2.png", "https://y/3.webp"]
    assert one(spark, "a\n Обявата  е изтрита. \nb", lambda c: T.removal_notice(c, F.lit(False))) and not one(spark, "Обявата е изтрита от сайта", lambda c: T.removal_notice(c, F.lit(False)))


@pytest.mark.parametrize("text,name,want", [("на 300 м от Южен парк", "Южен парк", 450.0), ("Южен парк на 2 км", "Южен парк", 3000.0), ("Южен парк - 50 м пеша", "Южен парк", 100.0), ("до Южен парк", "Южен парк", 500.0), ("на 5 км от Южен парк", "Южен парк", None), ("на 300 м от Южен парк на 400 м", "Южен парк", 500.0)])
def test_attached_radius(spark, text, name, want):
    at = text.index(name)
    assert one(spark, text, lambda c: T.attached_radius(c, F.lit(at), F.lit(at + len(name))))["radius"] == want


def test_contexts_and_addresses(spark):
    text = "апартаментът не е до Южен парк"
    assert one(spark, text, lambda c: T.excluded_context(c, F.lit(21), F.lit(30)))
    assert tuple(one(spark, "ул. Бяла № 12а", T.street_address)) == ("ул. Бяла", "12а")
    assert tuple(one(spark, "Бяла 5", T.street_address)) == ("Бяла", "5") and one(spark, "Бяла", T.street_address) is None
