"""Text expressions. A null text gives null unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
SECTION_HEADINGS = ("history of present illness", "history", "hospital course", "present illness")
SECTION = r"(?iu)(" + "|".join(SECTION_HEADINGS) + r"):[\s\x{85}\p{Z}]*([^\n]*(?:\n[^\n]+)*(?:\n\z)?)"
QUESTION = r"(?s)\A(.*?)([^.!?]+\?)\n?\z"
KEYWORDS = r"keywords[\s\S]*"
ANSWER = r"""(?i)Ans(?:wer|wee)*(?:\.|:)* *(?:is)* *(?:\(|'|"|-)* *[?:a-d|A-D]* *(?:\(|\)|'|")* *(?:i\.e\.|:)*(?:\.|,)*"""
NEGATIVE_ANSWERS = ("n/a", "no information", "does not mention", "no mention")
MALE, FEMALE = r"(?i)\s(?:male|man|boy)", r"(?i)\s(?:female|woman|girl)"
ABBREVIATIONS = ("dr", "mr", "mrs", "ms", "prof", "st", "vs", "etc", "e.g", "i.e", "fig", "no", "approx")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def utrim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def section(c: Column) -> Column:
    """The text after the first known heading up to a blank line; null without a heading."""
    return F.when(c.rlike(SECTION), F.regexp_extract(c, SECTION, 2))


def split_question(c: Column) -> Column:
    """Struct (context, question): the last sentence if it is a question; nulls otherwise."""
    found = c.rlike(QUESTION)
    return F.struct(F.when(found, F.regexp_extract(c, QUESTION, 1)).alias("context"), F.when(found, F.regexp_extract(c, QUESTION, 2)).alias("question"))


def strip_keywords(c: Column) -> Column:
    return F.regexp_replace(c, KEYWORDS, "")


def strip_answer(c: Column) -> Column:
    """Without references to an answer's letter."""
    return F.regexp_replace(c, ANSWER, "")


def swap_gender(factual: Column, other: Column) -> Column:
    """The other statement, with gender words swapped where both statements have the same gender."""
    male, other_male = factual.rlike(MALE), other.rlike(MALE)
    return F.when(male & other_male, F.regexp_replace(other, MALE.replace("(?i)", ""), " female")).when(~male & ~other_male, F.regexp_replace(other, FEMALE.replace("(?i)", ""), " male")).otherwise(other)


def mask_domains(c: Column, domains: list[str], ignore_case: bool = False) -> Column:
    """Domain names replaced by 'clinical'; of names that start alike, the first listed wins."""
    return F.regexp_replace(c, ("(?iu)" if ignore_case else "") + "|".join(f"\\Q{d}\\E" for d in domains), "clinical")


def differs(c: Column, value) -> Column:
    """Not equal to a value; a null differs from it."""
    return ~c.eqNullSafe(F.lit(value))


def without_text(c: Column, part: Column | str) -> Column:
    """Every place of another text taken out."""
    return F.replace(c, part if isinstance(part, Column) else F.lit(part), F.lit(""))


def unique_id(*parts: Column) -> Column:
    """A stable id from what makes a row unique; null and empty parts differ."""
    return F.md5(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("\u0002")) for p in parts)))


def stored_map(c: Column) -> Column:
    """A stored extraction as a map: a JSON object, the first of a list of them, or nothing at all where it can't be read."""
    kind = "map<string,string>"
    options = {"mode": "PERMISSIVE"}
    own, listed = F.from_json(c, kind, options), F.get(F.from_json(c, f"array<{kind}>", options), F.lit(0))
    none = F.create_map().cast(kind)
    return F.coalesce(F.when(F.ltrim(c).startswith("["), listed).when(F.ltrim(c).startswith("{"), own), none)


def normalize_answer(c: Column) -> Column:
    """'N/A' for answers that say there is nothing, otherwise trimmed."""
    low = F.lower(utrim(c))
    said = F.lit(False)
    for phrase in NEGATIVE_ANSWERS:
        said = said | low.contains(phrase)
    return F.when(said, F.lit("N/A")).otherwise(utrim(c))


def slug(c: Column) -> Column:
    return F.lower(F.translate(c, " /", "__"))


def sentences(c: Column) -> Column:
    """Sentences as an array: they end in . ! or ? (with closing quotes or brackets) before white space and a
    capital, digit or opening mark, unless the word before is a known abbreviation or one capital."""
    shield = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r"|[A-Z])\.(?=\s)"
    marked = F.regexp_replace(F.regexp_replace(utrim(c), shield, "$1\u0001"), r"([.!?][\"')\]]*)\s+(?=[\"'(\[]?[\p{Lu}\d])", "$1\u0002")
    return F.filter(F.transform(F.split(marked, "\u0002"), lambda s: utrim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def is_single_sentence(c: Column) -> Column:
    """Exactly one sentence; the text 'None' and null are none."""
    return F.coalesce((c != "None") & (F.size(sentences(c)) == 1), F.lit(False))


def all_but_last(s: Column) -> Column:
    """All sentences of an array but the last, joined; null for fewer than two."""
    return F.when(F.size(s) > 1, F.array_join(F.slice(s, 1, F.size(s) - 1), " "))


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), ""))


def fake_summary(before: Column, output: Column, after: Column) -> Column:
    return utrim(F.concat(before, F.lit(" "), utrim(F.lower(output)), F.lit(" "), after))


def default_explanation(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def prefixed(c: Column, prefix: str = "According to the context, ") -> Column:
    return F.concat(F.lit(prefix), c)


def in_locale(values: Column, lang: str) -> Column:
    """A text of a map by language, English failing that, or the empty text."""
    return F.coalesce(F.try_element_at(values, F.lit(lang)), F.try_element_at(values, F.lit("en")), F.lit(""))


def method_label(c: Column) -> Column:
    """'hps' as 'H + P + S', 'pn' as 'P*'."""
    return F.when(c == "pn", F.lit("P*")).otherwise(F.array_join(F.filter(F.split(F.upper(c), ""), lambda x: x != ""), " + "))


def param_count(label: Column) -> Column:
    return sum((F.when(label.contains(p), 1).otherwise(0) for p in "HPS"), F.lit(0))


def choice(key: Column, n: Column | int, salt: str = "") -> Column:
    """A stable number below n from a key: the first 32 bits of an MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long"), n if isinstance(n, Column) else F.lit(n))


def annotate(s: Column, mark: str) -> Column:
    """An array of sentences as numbered markup."""
    return F.array_join(F.transform(s, lambda x, i: F.concat(F.lit(f"<|{mark}"), (i + 1).cast("string"), F.lit("|><"), x, F.lit(f"><end||{mark}>"))), "")
