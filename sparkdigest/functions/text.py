"""Text functions as native expressions: folding, tokens, similarity, estimates, sanitising."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns.
WORD = r"([\p{L}\p{N}_]+)"
NOT_WORD = r"[^\p{L}\p{N}_]+"
SECTION_MARKER = r"(?i)\((?:product launch|sponsor|\d+\s*minute read)\)"
STORY_TOKEN = r"([A-Za-z][A-Za-z0-9.\-]*)"
CJK = r"[㐀-䶿一-鿿豈-﫿]"
URL = r"https?://\S+"
INJECTION = r"(?i)https?://|www\.|\[[^\]]*\]\([^)]*\)|<[a-z/!]"
CONTROL = r"[\x00-\x08\x0B-\x1F\x7F-\x9F\p{Cf}]"
# Estimated tokens of a character.
TOKENS_CJK, TOKENS_OTHER = 0.8, 0.3
# Language codes by alias.
LANGUAGES = {"zh-tw": "zh-tw", "zh-hant": "zh-tw", "zh-hk": "zh-tw", "zh-mo": "zh-tw", "zh-cn": "zh-cn", "zh-hans": "zh-cn"}


def fold(text: Column) -> Column:
    """Case folding: lower case with sharp s spelt out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalised_title(text: Column) -> Column:
    """Folded words joined by single spaces."""
    return F.trim(F.regexp_replace(fold(text), NOT_WORD, " "))


def word_tokens(text: Column) -> Column:
    """Distinct folded words, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(1)))


def word_text(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(1)), " ")


def identity_tokens(text: Column) -> Column:
    """Folded tokens that look like names or versions: a capital first or a digit inside, longer than one letter."""
    found = F.regexp_extract_all(F.regexp_replace(text, SECTION_MARKER, " "), F.lit(STORY_TOKEN), F.lit(1))
    named = F.filter(found, lambda t: (F.length(t) > 1) & t.rlike(r"^[A-Z]|\d"))
    return F.array_distinct(F.transform(named, F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common tokens; null if both sets are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def estimated_tokens(text: Column) -> Column:
    """A deliberately high estimate of a text's tokens for a prompt budget."""
    wide = F.regexp_count(text, F.lit(CJK))
    return F.ceil(wide * F.lit(TOKENS_CJK) + (F.length(text) - wide) * F.lit(TOKENS_OTHER)).cast("long")


def wrong_script(text: Column, expected: str) -> Column:
    """Chinese needs a CJK character; other languages at most half of them among what is no white space."""
    wide = F.regexp_count(text, F.lit(CJK))
    if expected.startswith("zh"):
        return wide == 0
    return wide * 2 > F.length(F.regexp_replace(text, r"\s", ""))


def language_code(language: Column) -> Column:
    code = F.replace(fold(language), F.lit("_"), F.lit("-"))
    alias = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, code), F.split_part(code, F.lit("-"), F.lit(1)))


def preview(text: Column, limit: int = 800) -> Column:
    shown = F.replace(text, F.lit("\n"), F.lit("\\n"))
    return F.concat(F.left(shown, F.lit(limit)), F.when(F.length(shown) > limit, "…").otherwise(""))


def injects_markup(text: Column) -> Column:
    """Whether model-owned text holds a link, Markdown link or tag."""
    return text.rlike(INJECTION)


def normalised_tags(tags: Column) -> Column:
    """Lower case, white space to hyphens, blanks dropped."""
    slug = F.transform(tags, lambda t: F.regexp_replace(F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")), " ", "-"))
    return F.filter(slug, lambda t: t != "")


def bounded_title(title: Column, limit: int = 200) -> Column:
    """A source's own headline without links and at most so long; the raw one if nothing else is left."""
    clean = F.left(F.trim(F.regexp_replace(F.regexp_replace(title, URL, " "), r"\s+", " ")), F.lit(limit))
    return F.coalesce(F.nullif(clean, F.lit("")), F.left(title, F.lit(limit)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def short_hash(text: Column, length: int = 10) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))


def model_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(":")), name).otherwise(F.concat(name, F.lit(":latest")))


# What a chat client would act on, and what stands in for it, in this order.
INERT = {
    r"(?i)@(everyone|here)\b": "＠$1",
    r"<@([!&]?)(\d+)>": "<＠$1$2>",
    r"(?i)(?<!\w)(https?)://": "$1[:]//",
    r"(?i)(?<!\w)www\.": "www[.]",
    r"(?m)^([ \t]*)([-+]|\d+[.)])(?=\s|#)": r"$1\\$2",
    r"(?m)^([ \t]*)(-{3,})[ \t]*$": r"$1\\$2",
    r"([\\*_~`|><#!\[\]()])": r"\\$1",
}


def inert_text(text: Column) -> Column:
    """Untrusted text made inert for a chat client: no control signs, mentions, links, lists, rules or markup."""
    text = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), CONTROL, "")
    for pattern, instead in INERT.items():
        text = F.regexp_replace(text, pattern, instead)
    return text


def agenda_cell(text: Column) -> Column:
    """One line of an agenda: no links or control signs, white space single, mentions and code marks defused."""
    text = F.regexp_replace(F.regexp_replace(text, URL, ""), CONTROL, "")
    text = F.replace(F.replace(text, F.lit("@"), F.lit("@​")), F.lit("`"), F.lit("ˋ"))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def links_of(text: Column) -> Column:
    """Distinct links in order of appearance, without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(f"({URL})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def string_list(value: Column) -> Column:
    """A JSON list of strings: struct(ids, error); null is an empty list, anything else an error code."""
    parsed = F.from_json(value, "array<string>")
    plain = value.rlike(r'^\s*\[\s*(?:"(?:[^"\\]|\\.)*"\s*(?:,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')
    ok = value.isNull() | F.coalesce(plain & parsed.isNotNull(), F.lit(False))
    ids = F.when(value.isNull(), F.array().cast("array<string>")).when(ok, parsed)
    return F.struct(ids.alias("ids"), F.when(~ok, "DISCORD_MESSAGE_IDS_CORRUPT").alias("error"))


def known_code(code: Column, known: list[str], other: str) -> Column:
    """A code of a closed set, or the one for all others."""
    return F.when(code.isin(known), code).otherwise(F.lit(other))


# What an article's error says of its link.
URL_CODES = {
    "ARTICLE_URL_BLOCKED": "URL_POLICY_BLOCKED",
    "ARTICLE_REDIRECT_BLOCKED": "URL_REDIRECT_BLOCKED",
    "ARTICLE_FETCH_DEADLINE_EXCEEDED": "URL_RESOLUTION_DEADLINE_EXCEEDED",
    "ARTICLE_FETCH_TIMEOUT": "URL_RESOLUTION_TIMEOUT",
    "ARTICLE_CONTENT_TYPE_UNSUPPORTED": "URL_CONTENT_TYPE_UNSUPPORTED",
    "ARTICLE_TOO_LARGE": "URL_METADATA_TOO_LARGE",
}


def url_code(article_code: Column) -> Column:
    """The code of a link whose article failed; null where nothing failed, URL_RESOLUTION_FAILED for any other code."""
    known = F.create_map(*[F.lit(x) for pair in URL_CODES.items() for x in pair])
    return F.when(article_code.isNotNull(), F.coalesce(F.try_element_at(known, article_code), F.lit("URL_RESOLUTION_FAILED")))
