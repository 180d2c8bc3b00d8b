"""Rules of the nine sites: where articles and lists are linked, how a page's category is named, what text it must have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernel.functions.text import slashes, url_decoded


@dataclass(frozen=True)
class Site:
    name: str
    least_chars: int
    depth: int
    delay_s: int
    default_category: str | None = None


# Least text lengths, crawl depths, delays, default categories.
SITES = [
    Site("journaldoctor", 100, 7, 3),
    Site("bnews", 50, 10, 5, "unknown"),
    Site("rmj", 50, 10, 5),
    Site("wikipedia", 50, 10, 2, "Wikipedia"),
    Site("ruwiki", 30, 20, 1, "Медицина"),
    Site("probolezny", 150, 6, 3),
    Site("takzdorovo", 100, 7, 3),
    Site("clinickrasnodar", 100, 6, 5),
    Site("bigenc", 150, 8, 4, "unknown"),
]
ITEM_CAP = 50_000

# Section keys of one site and the names of their categories, the first that a URL has wins.
BIGENC_CATEGORIES = {
    "medics": "Медики",
    "biology": "Биология",
    "medicine": "Медицина",
    "psychology": "Психология",
    "internal_organs": "Внутренние органы",
    "symptoms": "Симптомы",
    "diseases": "Болезни",
    "anatomy": "Анатомия",
    "physiology": "Физиология",
    "biochemistry": "Биохимия",
    "pharmaceutics": "Фармацевтика",
    "pharmacology": "Фармакология",
    "genetics": "Генетика",
}
BNEWS_SECTIONS = ["science", "news", "techno", "life", "career", "special"]

# Parts of a URL or title that rule it out.
JOURNALDOCTOR_FILES = [".pdf", ".jpg", ".png", ".gif", ".css", ".js"]
JOURNALDOCTOR_TITLES = ["каталог", "главная", "контакты", "о нас", "поиск", "catalog"]
BNEWS_SERVICE = ["/about", "/contacts", "/policy", "/tag/", "/author/", "#"]
PROBOLEZNY_SERVICE = ["/author/", "/clinic/", "/doctor/", "/user/", "/login", "/register"]
WIKI_SERVICE = ["Служебная:", "Обсуждение:", "Участник:", "Файл:", "Шаблон:", "Портал:", "Справка:"]
RUWIKI_SERVICE = ["Служебная", "Обсуждение", "Рувики:", "Файл:"]
RUWIKI_CATEGORIES = ["Рувики:Избранные", "Рувики:Хорошие", "Рувики:Выверенные"]


def has_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def first_that(c: Column, names: dict[str, str], before: str, otherwise: str | None) -> Column:
    """The value of the first key that c contains after `before`."""
    out = None
    for k, v in names.items():
        hit = c.contains(before + k)
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out.otherwise(F.lit(otherwise))


def category_of(site: str, url: Column) -> Column:
    """The category that a page's URL names, for the sites that have it there; else null."""
    if site == "bigenc":
        return first_that(url, BIGENC_CATEGORIES, "/t/", "unknown")
    if site == "bnews":
        return first_that(url, {s: s for s in BNEWS_SECTIONS}, "/", "unknown")
    if site == "rmj":
        return F.nullif(F.regexp_extract(url, "/articles/([^/]+)/", 1), F.lit(""))
    return F.lit(None).cast("string")


def _after(url: Column, mark: str) -> Column:
    """What follows the last occurrence of mark, without slashes at its ends."""
    return F.trim(F.element_at(F.split(url, mark), -1), F.lit("/"))


def link_kind(site: str, url: Column) -> Column:
    """What an absolute link leads to: `article`, `list`, or null where it isn't followed."""
    none = F.lit(None).cast("string")
    if site == "journaldoctor":
        return F.when(url.contains("journaldoctor.ru") & ~has_any(F.lower(url), JOURNALDOCTOR_FILES), "article").otherwise(none)
    if site == "bnews":
        ours = url.contains("b-news.media") & ~has_any(url, BNEWS_SERVICE)
        return F.when(ours & (slashes(url) >= 4), "article").when(ours & (slashes(url) == 3), "list").otherwise(none)
    if site == "rmj":
        path = F.trim(F.regexp_replace(url, r"https?://www\.rmj\.ru/articles/", ""), F.lit("/"))
        section = F.regexp_extract(url, "/articles/([^/?]+)/", 1)
        slug = F.when(section != "", F.trim(F.regexp_extract(url, "/articles/[^/?]+/(.*)$", 1), F.lit("/")))
        article = (F.coalesce(slug, F.lit("")) != "") & ~slug.contains("/") & ~slug.contains("?") & (slug != section)
        return F.when(url.contains("/articles/") & (path != "") & ~path.contains("/") & ~path.startswith("?"), "list").when(article, "article").otherwise(none)
    if site == "wikipedia":
        page = url_decoded(url)
        served = ~has_any(page, WIKI_SERVICE)
        return F.when(served & (page.contains("Категория:") | url.contains("/wiki/Category:")), "list").when(served & url.contains("/wiki/"), "article").otherwise(none)
    if site == "ruwiki":
        page = url_decoded(url)
        return F.when(page.contains("/wiki/Категория:"), F.when(~has_any(page, RUWIKI_CATEGORIES), F.lit("list"))).when(page.contains("/wiki/") & ~has_any(page, RUWIKI_SERVICE), "article").otherwise(none)
    if site == "probolezny":
        return F.when(url.contains("probolezny.ru") & (url != "https://probolezny.ru/") & ~has_any(url, PROBOLEZNY_SERVICE), "article").otherwise(none)
    if site == "takzdorovo":
        slug = F.trim(F.regexp_replace(url, r"https?://www\.takzdorovo\.ru/stati/", ""), F.lit("/"))
        home = F.regexp_replace(url, "/+$", "") == "https://www.takzdorovo.ru/stati"
        return F.when(url.contains("/stati/?rubrika=") | url.contains("/stati?rubrika="), "list").when(url.contains("/stati/") & ~url.contains("?") & ~home & (slug != "") & ~slug.startswith("page"), "article").otherwise(none)
    if site == "clinickrasnodar":
        parts = F.size(F.filter(F.split(_after(url, "/articles/"), "/"), lambda p: p != ""))
        return F.when(url.contains("/articles/"), F.when(parts >= 2, F.lit("article")).when(parts == 1, F.lit("list"))).otherwise(none)
    if site == "bigenc":
        return F.when(url.contains("/c/"), "article").otherwise(none)
    raise ValueError(f"no rules for {site}")


def is_next_page(site: str, link: Column) -> Column:
    """Whether a link in a list's page bar leads on."""
    if site == "rmj":
        return link.contains("PAGEN") | F.lower(link).contains("page")
    if site == "clinickrasnodar":
        return link.contains("PAGEN")
    return link != ""


def skipped_title(site: str, title: Column) -> Column:
    return has_any(F.lower(title), JOURNALDOCTOR_TITLES) if site == "journaldoctor" else F.lit(False)
