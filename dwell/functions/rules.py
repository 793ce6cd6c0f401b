"""Text rules of case records as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that decide each field, in their order of precedence.
YES = ("true", "1", "yes", "是", "有", "diy")
NO = ("false", "0", "no", "否", "无")
EDUCATION = (
    ("PhD", "Postgraduate Research", ("博士", "phd", "doctoral", "doctorate")),
    ("Master", "Higher Education", ("硕士", "master", "研究生")),
    ("Bachelor", "Higher Education", ("本科", "bachelor", "undergraduate")),
    ("School", "Schools", ("中学", "school")),
    ("ELICOS", "Independent ELICOS", ("语言", "elicos", "english")),
    ("VET", "Vocational Education and Training", ("职业", "vet", "tafe")),
)
FIELDS = (
    ("Health and Medicine", ("医", "health", "medicine", "medical", "nursing", "mdhs", "pharma")),
    ("Engineering", ("工程", "engineering", "civil", "mechanical", "electrical", "材料")),
    ("Computing and Data", ("计算机", "computer", "software", "data", "统计", "ai", "人工智能")),
    ("Natural Sciences", ("biology", "microbiology", "chem", "physics", "science", "生物", "化学", "物理")),
    ("Business and Economics", ("商", "business", "finance", "account", "econom", "management")),
    ("Education", ("教育", "education", "teaching")),
    ("Humanities and Social Sciences", ("人文", "社科", "social", "humanit", "law", "法律", "arts")),
    ("Built Environment", ("建筑", "architecture", "construction", "urban", "planning")),
)
OUTSIDE = ("国内", "境外", "offshore", "outside")
INSIDE = ("澳洲", "境内", "onshore", "inside")
PARTNER_YES = ("携", "配偶", "couple", "partner", "副申")
PARTNER_NO = ("单独", "single", "alone")
GROUP_OF_EIGHT = ("monash", "melbourne", "unsw", "sydney", "queensland", "uq", "anu", "australian national", "adelaide", "western australia", "uwa", "go8", "八大")
SECTORS_WITH_STREAM = ("Postgraduate Research", "Higher Education", "Independent ELICOS", "Schools", "Vocational Education and Training", "Non-Award", "Foreign Affairs or Defence")
POST_EDUCATION = (
    ("PhD", "Postgraduate Research", ("博士", "phd", "doctoral")),
    ("Master", "Higher Education", ("硕士", "master")),
    ("Bachelor", "Higher Education", ("本科", "bachelor")),
)
POST_OUTSIDE = ("国内递交", "境外递交", "offshore", "outside australia")
POST_INSIDE = ("澳洲境内", "境内递交", "onshore", "in australia")


def _plain(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def _any(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def _first(c: Column, rules, default: str) -> Column:
    """The value of the first rule of which a word is in ``c``."""
    return reduce(lambda rest, rule: F.when(_any(c, rule[1]), F.lit(rule[0])).otherwise(rest), reversed(tuple(rules)), F.lit(default))


def iso_date(c: Column) -> Column:
    """The date in the first ten characters, if they are exactly YYYY-MM-DD and valid."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def boolish(c: Column) -> Column:
    text = _plain(c)
    return F.when(text.isin(*YES), "yes").when(text.isin(*NO), "no").otherwise("unknown")


def education_level(c: Column, rules=EDUCATION) -> Column:
    return _first(_plain(c), [(level, words) for level, _, words in rules], "Unknown")


def study_sector(c: Column, rules=EDUCATION) -> Column:
    return _first(_plain(c), [(sector, words) for _, sector, words in rules], "Unknown")


def field_group(c: Column) -> Column:
    text = _plain(c)
    return F.when(text == "", "Unknown").otherwise(_first(text, FIELDS, "Other"))


def location(c: Column, outside=OUTSIDE, inside=INSIDE) -> Column:
    return _first(_plain(c), (("Outside Australia", outside), ("In Australia", inside)), "Unknown")


def partner(c: Column) -> Column:
    text = _plain(c)
    return F.when(_any(text, PARTNER_YES), "yes").when(_any(text, PARTNER_NO), "no").otherwise(boolish(c))


def provider_group(c: Column) -> Column:
    text = F.regexp_replace(_plain(c), r"\s+", " ")
    return F.when(text == "", "Unknown").when(_any(text, GROUP_OF_EIGHT), "Group of Eight").otherwise("Other/Unverified")


def platform(url: Column) -> Column:
    """The platform of a public URL, by its host with port."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    return (
        F.when(_any(host, ("xiaohongshu", "xhslink")), "Xiaohongshu").when(host.contains("weibo"), "Weibo")
        .when(host.endswith("x.com") | host.contains("twitter.com"), "X").when(host.contains("reddit.com"), "Reddit").otherwise("PublicWeb")
    )


def calendar_month(fiscal_year: Column, month: Column) -> Column:
    """YYYY-MM of month 1 to 12 of an Australian fiscal year such as 2025-26, whose first month is July."""
    start = fiscal_year.substr(1, 4).cast("int")
    year = F.when(month <= 6, start).otherwise(start + 1)
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(((month + 5) % 12 + 1).cast("string"), 2, "0"))


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def stream_for_sector(c: Column) -> Column:
    """The official stream of a study sector; other values stand for themselves."""
    return F.when(c.isin(*SECTORS_WITH_STREAM), F.concat(c, F.lit(" Sector"))).otherwise(c)


def percentage(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(part / total, 4))


def json_text(names: list[str]) -> Column:
    """A record as JSON with sorted keys, ``", "`` and ``": "`` between parts, nulls kept."""
    value = lambda n: F.when(F.col(n).isNull(), F.lit("null")).otherwise(F.expr(f"substring({_quoted(n)}, 6, length({_quoted(n)}) - 6)"))
    return F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), value(n)) for n in sorted(names)]), F.lit("}"))


def _quoted(name: str) -> str:
    return f"to_json(struct(cast(`{name}` as string) as v))"
