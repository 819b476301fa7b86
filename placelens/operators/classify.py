"""Classification by ordered rule tables, with a recorded basis."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_normalised, plain_normalised

Rules = tuple[tuple[str, str], ...]

#: Enshrined names and the families that they point to, in order of precedence.
DEITY_RULES: Rules = (
    ("八幡神", "hachiman"), ("応神天皇", "hachiman"), ("誉田別命", "hachiman"),
    ("稲荷神", "inari"), ("ウカノミタマ", "inari"), ("宇迦之御魂", "inari"), ("倉稲魂", "inari"),
    ("天満大自在天神", "tenjin"), ("菅原道真", "tenjin"),
    ("建御名方", "suwa"), ("八坂刀売", "suwa"),
    ("熊野権現", "kumano"), ("家都御子", "kumano"), ("熊野牟須美", "kumano"),
    ("大山咋", "hie_sanno"),
    ("素戔嗚", "gion_yasaka"), ("スサノオ", "gion_yasaka"), ("牛頭天王", "gion_yasaka"),
    ("春日神", "kasuga"), ("天児屋根", "kasuga"),
    ("タケミカヅチ", "kashima_katori"), ("建御雷", "kashima_katori"),
    ("経津主", "kashima_katori"), ("フツヌシ", "kashima_katori"),
    ("住吉", "sumiyoshi"), ("底筒", "sumiyoshi"), ("中筒", "sumiyoshi"), ("上筒", "sumiyoshi"),
    ("宗像", "munakata"), ("市杵島", "munakata"), ("田心", "munakata"), ("湍津", "munakata"),
    ("菊理媛", "hakusan"), ("白山比咩", "hakusan"),
    ("愛宕", "atago"), ("火産霊", "atago"), ("迦具土", "atago"),
    ("秋葉", "akiba"),
    ("金山彦", "konpira"), ("大物主", "konpira"),
    ("神功皇后", "hachiman"),
    ("天照大神", "shinmei_ise"), ("天照大御神", "shinmei_ise"),
)
#: Parts of names and the families that they point to, in order of precedence.
NAME_RULES: Rules = (
    ("稲荷", "inari"), ("八幡", "hachiman"), ("天満", "tenjin"), ("天神", "tenjin"), ("諏訪", "suwa"), ("熊野", "kumano"),
    ("日吉", "hie_sanno"), ("日枝", "hie_sanno"), ("山王", "hie_sanno"),
    ("八坂", "gion_yasaka"), ("祇園", "gion_yasaka"), ("素盞嗚", "gion_yasaka"), ("津島", "gion_yasaka"),
    ("春日", "kasuga"), ("鹿島", "kashima_katori"), ("香取", "kashima_katori"), ("住吉", "sumiyoshi"),
    ("宗像", "munakata"), ("厳島", "munakata"), ("白山", "hakusan"), ("愛宕", "atago"), ("秋葉", "akiba"),
    ("金刀比羅", "konpira"), ("琴平", "konpira"), ("金比羅", "konpira"),
    ("神明", "shinmei_ise"), ("皇大神", "shinmei_ise"), ("大神宮", "shinmei_ise"),
)


@dataclass(frozen=True)
class RuleBook:
    """Ordered rules over members and names, and how members together change the reading."""

    members: Rules = DEITY_RULES
    names: Rules = NAME_RULES
    #: (word, family): a name with the word never counts for the family.
    excluded: Rules = (("第六天", "tenjin"), ("天神地祇", "tenjin"))
    #: A family that becomes another one beside a companion.
    turns: tuple[str, str] = ("kashima_katori", "kasuga")
    companions: tuple[str, ...] = ("天児屋根", "春日神", "比売大神")
    weak: tuple[str, ...] = field(default=("shinmei_ise",))


STANDARD = RuleBook()


def _table(rules: Rules) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(f).alias("family")) for k, f in rules])


def _families(rules: Rules, fits) -> Column:
    """Distinct families of the rules that fit, in order of the rules."""
    return F.array_distinct(F.transform(F.filter(_table(rules), lambda r: fits(r["key"])), lambda r: r["family"]))


def families_of_members(members: Column, book: RuleBook = STANDARD) -> Column:
    """Families that the members point to, in order of the rules, whatever the order of the members."""
    hits = _families(book.members, lambda key: F.exists(members, lambda m: F.contains(m, key)))
    beside = F.exists(members, lambda m: F.exists(F.array(*map(F.lit, book.companions)), lambda c: F.contains(m, c)))
    old, new = book.turns
    turned = F.concat(F.array(F.lit(new)), F.array_except(hits, F.array(F.lit(old), F.lit(new))))
    return F.when(F.array_contains(hits, old) & beside, turned).otherwise(hits)


def families_of_name(name: Column, book: RuleBook = STANDARD) -> Column:
    blocked = _families(book.excluded, lambda key: F.contains(name, key))
    hits = _families(book.names, lambda key: F.contains(name, key))
    return F.array_except(hits, blocked)


def family_of_groups(groups: Column, book: RuleBook = STANDARD) -> Column:
    """Of the first group that any rule fits, the family of its first rule; else null."""
    each = F.transform(groups, lambda g: F.get(_families(book.names, lambda key: F.contains(g, key)), 0))
    return F.get(F.filter(each, lambda f: f.isNotNull()), 0)


def classified(rows: DataFrame, name: str = "name", members: str = "members", groups: str = "groups", book: RuleBook = STANDARD) -> DataFrame:
    """Adds label, basis (structured, deity, name or none), confidence and alternatives.

    What a higher basis decides is not overruled: groups first, then members,
    then the name.  Nothing found is unknown with confidence 0.
    """
    rows = rows.withColumns({"_m": all_normalised(F.col(members)), "_g": all_normalised(F.col(groups)), "_n": plain_normalised(F.col(name))})
    rows = rows.withColumns({"_s": family_of_groups(F.col("_g"), book), "_d": families_of_members(F.col("_m"), book), "_w": families_of_name(F.col("_n"), book)})
    none = F.array().cast("array<string>")
    verdict = lambda label, basis, confidence, alternatives: F.struct(label.alias("label"), F.lit(basis).alias("basis"), confidence.cast("double").alias("confidence"), alternatives.alias("alternatives"))
    first, others = F.get("_d", 0), F.slice("_d", 2, 100)
    old, new = book.turns
    sure = F.greatest(F.lit(0.55), 0.92 - 0.12 * F.size(others))
    sure = F.when(first == old, F.least(sure, F.lit(0.70))).when(first.isin(*book.weak), F.least(sure, F.lit(0.65))).otherwise(sure)
    others = F.when(first == old, F.array_union(others, F.array(F.lit(new)))).otherwise(others)
    by_name, rest = F.get("_w", 0), F.slice("_w", 2, 100)
    result = F.coalesce(
        F.when(F.col("_s").isNotNull(), verdict(F.col("_s"), "structured", F.lit(0.95), none)),
        F.when(first.isNotNull(), verdict(first, "deity", F.round(sure, 2), others)),
        F.when(by_name.isNotNull(), verdict(by_name, "name", F.round(F.greatest(F.lit(0.45), 0.75 - 0.10 * F.size(rest)), 2), rest)),
        verdict(F.lit("unknown"), "none", F.lit(0.0), none),
    )
    return rows.withColumn("_v", result).select(*[c for c in rows.columns if c[0] != "_"], "_v.*")


def two_signals(rows: DataFrame, name: str = "name", members: str = "members", book: RuleBook = STANDARD) -> DataFrame:
    """Adds by_members, by_name and signal: agree, disagree, or null unless both know."""
    rows = rows.withColumns({"_m": all_normalised(F.col(members)), "_n": plain_normalised(F.col(name))})
    rows = rows.withColumns({"by_members": F.get(families_of_members(F.col("_m"), book), 0), "by_name": F.get(families_of_name(F.col("_n"), book), 0)}).drop("_m", "_n")
    return rows.withColumn("signal", F.when(F.col("by_members") == F.col("by_name"), "agree").when(F.col("by_members") != F.col("by_name"), "disagree"))
