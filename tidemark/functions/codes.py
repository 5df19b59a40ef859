"""Codes and their names, as expressions; an unknown or null code has a name too."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
SOURCE_KIND = {1: "google_docs", 2: "google_slides", 3: "pdf", 4: "pasted_text", 5: "web_page", 8: "markdown", 9: "youtube", 10: "media", 11: "docx", 13: "image", 14: "google_spreadsheet", 16: "csv", 17: "epub"}
SOURCE_STATUS = {1: "processing", 2: "ready", 3: "error", 5: "preparing"}
ARTIFACT_KIND = {1: "audio", 2: "report", 3: "video", 5: "mind_map", 7: "infographic", 8: "slide_deck", 9: "data_table"}
QUIZ_FAMILY = {1: "flashcards", 2: "quiz", 4: "mind_map"}
RESEARCH = {1: "in_progress", 2: "completed", 3: "no_results", 4: "cancelled", 6: "completed"}
RESULT_TYPE = {"web": 1, "drive": 2, "report": 5}
TIER = {1: ("Standard", 100, 50), 2: ("Pro", 500, 300), 3: ("Ultra 20 TB", 500, 500), 4: ("Plus", 200, 100), 6: ("Ultra 30 TB", 500, 600)}
CATEGORIES = (
    "not_found", "auth", "rate_limited", "validation", "config", "dependency", "network", "notebook_limit",
    "artifact_timeout", "timeout", "server", "rpc", "source_mutation", "source_add", "library", "unexpected",
)
RETRIABLE = ("rate_limited", "server", "timeout", "artifact_timeout", "network")
LANGUAGE = {
    "en": "English", "zh_Hans": "中文（简体）", "zh_Hant": "中文（繁體）", "es": "Español", "es_419": "Español (Latinoamérica)", "es_MX": "Español (México)",
    "hi": "हिन्दी", "ar_001": "العربية", "ar_eg": "العربية (مصر)", "pt_BR": "Português (Brasil)", "pt_PT": "Português (Portugal)", "bn": "বাংলা", "ru": "Русский",
    "ja": "日本語", "pa": "ਪੰਜਾਬੀ", "de": "Deutsch", "jv": "Basa Jawa", "ko": "한국어", "fr": "Français", "fr_CA": "Français (Canada)", "te": "తెలుగు",
    "vi": "Tiếng Việt", "mr": "मराठी", "ta": "தமிழ்", "tr": "Türkçe", "ur": "اردو", "it": "Italiano", "th": "ไทย", "gu": "ગુજરાતી", "fa": "فارسی",
    "pl": "Polski", "uk": "Українська", "ml": "മലയാളം", "kn": "ಕನ್ನಡ", "or": "ଓଡ଼ିଆ", "my": "မြန်မာဘာသာ", "sw": "Kiswahili", "nl_NL": "Nederlands",
    "ro": "Română", "hu": "Magyar", "el": "Ελληνικά", "cs": "Čeština", "sv": "Svenska", "be": "Беларуская", "bg": "Български", "hr": "Hrvatski",
    "sk": "Slovenčina", "da": "Dansk", "fi": "Suomi", "nb_NO": "Norsk Bokmål", "nn_NO": "Norsk Nynorsk", "he": "עברית", "iw": "עברית", "id": "Bahasa Indonesia",
    "ms": "Bahasa Melayu", "fil": "Filipino", "ceb": "Cebuano", "sr": "Српски", "sl": "Slovenščina", "sq": "Shqip", "mk": "Македонски", "lt": "Lietuvių",
    "lv": "Latviešu", "et": "Eesti", "hy": "Հայերեն", "ka": "ქართული", "az": "Azərbaycanca", "af": "Afrikaans", "am": "አማርኛ", "eu": "Euskara",
    "ca": "Català", "gl": "Galego", "is": "Íslenska", "la": "Latina", "ne": "नेपाली", "ps": "پښتو", "sd": "سنڌي", "si": "සිංහල",
    "ht": "Kreyòl Ayisyen", "kok": "कोंकणी", "mai": "मैथिली",
}


HINTS = {
    "not_found": "check the id; it may have been deleted", "auth": "log in again", "rate_limited": "wait, then try again", "validation": "correct the input",
    "config": "check the settings", "dependency": "install what is missing", "network": "check the connection, then try again", "notebook_limit": "delete a notebook first",
    "artifact_timeout": "ask again later: it is still being made", "timeout": "try again with more time", "server": "try again later",
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(code: Column | str, names: dict, other: str = "unknown") -> Column:
    table = F.create_map(*map(F.lit, itertools.chain(*names.items())))
    return F.coalesce(F.try_element_at(table, _col(code).cast("int")), F.lit(other))


def source_kind(code: Column | str, mime: Column | str | None = None) -> Column:
    """Code 14 is a spreadsheet unless its MIME type says that it is a PDF."""
    known = named(code, SOURCE_KIND)
    return known if mime is None else F.when((_col(code) == 14) & (_col(mime) == "application/pdf"), "pdf").otherwise(known)


def source_status(code: Column | str) -> Column:
    return named(code, SOURCE_STATUS)


def artifact_kind(code: Column | str, variant: Column | str) -> Column:
    return F.when(_col(code) == 4, named(variant, QUIZ_FAMILY)).otherwise(named(code, ARTIFACT_KIND))


def report_subtype(code: Column | str, title: Column | str) -> Column:
    low = F.lower(_col(title))
    return F.when(_col(code) == 2, F.when(low.startswith("briefing doc"), "briefing_doc").when(low.startswith("study guide"), "study_guide").when(low.startswith("blog post"), "blog_post").otherwise("report"))


def research_status(code: Column | str) -> Column:
    """in_progress, completed or failed; no code yet means in progress, an unknown one failed."""
    reason = named(code, RESEARCH)
    return F.when(_col(code).isNull() | (reason == "in_progress"), "in_progress").when(reason == "completed", "completed").otherwise("failed")


def epoch(seconds: Column | str) -> Column:
    """UTC timestamp, null where there is none or it is out of range (years 1 to 9999)."""
    s = _col(seconds)
    return F.when(s.between(-62135596800, 253402300799), F.timestamp_seconds(s))


def score(c: Column | str) -> Column:
    """A finite number from 0 to 1, else null."""
    return F.when(_col(c).between(0, 1) & ~F.isnan(_col(c)), _col(c))


def span(start: Column | str, end: Column | str) -> Column:
    """start and end, or null where either is missing, negative or the wrong way round."""
    a, b = _col(start), _col(end)
    return F.when((a >= 0) & (b >= a), F.struct(a.alias("start"), b.alias("end")))


def language(code: Column | str) -> Column:
    """A language code's own name; null where the code is not one (codes are told apart by case)."""
    table = F.create_map(*map(F.lit, itertools.chain(*LANGUAGE.items())))
    return F.try_element_at(table, _col(code))


def termination(code: Column | str, n_sources: Column | str) -> Column:
    """Why a research run ended; ``no_results`` isn't said of a run that has sources. Null without a code."""
    reason = named(code, RESEARCH)
    return F.when(_col(code).isNotNull(), F.when((reason == "no_results") & (_col(n_sources) > 0), "unknown").otherwise(reason))


def termination_message(reason: Column | str, code: Column | str, query: Column | str, source_type: Column | str) -> Column:
    """What to tell of a run that ended otherwise than well, by its termination(); null of one that went well or is going on."""
    asked = F.coalesce(F.concat(F.lit(" for '"), F.nullif(_col(query), F.lit("")), F.lit("'")), F.lit(""))
    where = F.when(_col(source_type) == 1, " of the web").when(_col(source_type) == 2, " of the drive").otherwise("")
    return (
        F.when(_col(reason).isin("completed", "in_progress"), None)
        .when(_col(reason) == "no_results", F.concat(F.lit("the search"), where, F.lit(" found nothing"), asked))
        .when(_col(reason) == "cancelled", F.concat(F.lit("the run"), asked, F.lit(" was cancelled")))
        .when(_col(reason).isNotNull(), F.concat(F.lit("the run"), asked, F.lit(" ended with code "), _col(code).cast("string")))
    )


def termination_hint(reason: Column | str, source_type: Column | str) -> Column:
    """What could be done about it, by what was searched; null where nothing is to be done."""
    broader, by_name = "try a broader query", "try the exact name, the address or the id of the document"
    nothing = F.when(_col(source_type) == 2, by_name).when(_col(source_type) == 1, broader).otherwise(f"{broader}; in a drive, {by_name}")
    return F.when(_col(reason) == "no_results", nothing).when(_col(reason) == "cancelled", "start the run again if its sources are needed").when(_col(reason) == "unknown", "taken for ended: start a new run")


def error_hint(category: Column | str) -> Column:
    """What could be done about a failure of a category; null where nothing general can be said."""
    return F.try_element_at(F.create_map(*map(F.lit, itertools.chain(*HINTS.items()))), _col(category))


def error_category(names: Column | str) -> Column:
    """Of the categories that fit a failure (an array), the first in the fixed order; ``unexpected`` where none does."""
    order = F.array(*map(F.lit, CATEGORIES))
    return F.coalesce(F.try_element_at(F.filter(order, lambda c: F.array_contains(_col(names), c)), F.lit(1)), F.lit(CATEGORIES[-1]))


def retriable(category: Column | str) -> Column:
    return _col(category).isin(*RETRIABLE)


def rate_limited(status: Column | str, code: Column | str, error: Column | str) -> Column:
    """A failed or removed task that was turned away: by its code, else by what its text says."""
    low = F.lower(_col(error))
    said = low.contains("rate limit") | low.contains("quota") | low.contains("limit exceeded")
    return _col(status).isin("failed", "removed") & (F.coalesce(_col(code) == "USER_DISPLAYABLE_ERROR", F.lit(False)) | F.coalesce(said, F.lit(False)))


def hyphenated(kind: Column | str) -> Column:
    return F.replace(_col(kind), F.lit("_"), F.lit("-"))
