"""Text predicates as columns. All run inside the JVM; patterns are literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these lists and patterns.
MALE_PRONOUNS = ("he", "him", "his", "himself")
FEMALE_PRONOUNS = ("she", "her", "hers", "herself")
REAL_PEOPLE = (
    "mark zuckerberg", "elon musk", "bill gates", "jeff bezos", "tim cook", "sundar pichai", "satya nadella", "sam altman", "larry page", "sergey brin", "jack ma", "warren buffett", "steve jobs", "richard branson", "indra nooyi", "mary barra", "ginni rometty", "sheryl sandberg", "florence nightingale", "marie curie", "albert einstein", "amelia earhart", "neil armstrong",
    "michael jackson", "elvis presley", "taylor swift", "barack obama", "donald trump", "joe biden", "oprah winfrey", "michael jordan", "lebron james", "serena williams", "tom hanks", "tom cruise", "brad pitt", "leonardo dicaprio", "beyonce", "madonna", "lady gaga", "kim kardashian", "princess diana", "queen elizabeth", "john lennon", "paul mccartney", "freddie mercury", "martin luther king", "abraham lincoln", "george washington", "isaac newton", "stephen hawking", "nikola tesla", "thomas edison", "ada lovelace", "grace hopper", "alan turing", "linus torvalds", "gordon ramsay", "jamie oliver",
)
#: The legacy chain looks for the first of these only, and anywhere in the text.
LEGACY_REAL_PEOPLE = REAL_PEOPLE[:23]
REFUSALS = ("as an ai", "ai language model", "i'm sorry", "i am sorry", "i cannot", "i can't help", "i can't assist", "i can't write", "i'm unable", "i am unable")
QUOTED = r'"[^"]*"|“[^”]*”'
FIRST_PERSON = r"I|(?i:my|me|myself)"
OTHER_PEOPLE = (
    "colleague", "coworker", "co-worker", "boss", "manager", "assistant", "friend", "patient", "customer", "client", "visitor", "guest", "student", "child", "kid", "son", "daughter", "wife", "husband", "partner", "mother", "father", "mom", "dad", "sister", "brother", "passenger", "man", "woman", "boy", "girl", "stranger",
)
NON_LATIN = r"[Ѐ-ӿ؀-ۿ぀-ヿ一-鿿가-힯]"

PRONOUNS = {"male": MALE_PRONOUNS, "female": FEMALE_PRONOUNS}
ALTERNATION = {g: "|".join(p) for g, p in PRONOUNS.items()}
#: What words are made of, in any script.
LETTER = r"[\p{L}\p{N}_]"


def one_of(words: tuple[str, ...]) -> str:
    """A pattern of any of the words or phrases, shared beginnings first, so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c).replace("\\ ", " ") + ("" if rest == [""] else one_of(tuple(rest))) for c, rest in by.items() if c]
    if "" in by:  # a word ends here
        return f"(?:{'|'.join(parts)})?" if parts else ""
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def whole_words(pattern: str, first: str) -> str:
    """The pattern where no letter, digit or underscore of any script stands before or after it.

    first: the letters it can begin with, looked at before anything else.
    """
    return rf"(?=[{first}])(?<!{LETTER})(?:{pattern})(?!{LETTER})"


def any_case(words: tuple[str, ...], end: str = "") -> str:
    """Whole words or phrases in any case."""
    letters = sorted({c for w in words for c in (w[0].lower(), w[0].upper())})
    return whole_words(f"(?i:{one_of(words)}{end})", "".join(letters))


FIRST = whole_words(FIRST_PERSON, "ImM")


def pronoun_count(text: Column, gender: str) -> Column:
    """Whole-word pronouns of a gender, in any case."""
    return F.regexp_count(text, F.lit(any_case(PRONOUNS[gender]))).cast("long")


def gender_of(male: Column, female: Column) -> Column:
    """male or female where only one kind occurs, mixed where both do, else none."""
    return F.when((male > 0) & (female > 0), "mixed").when(male > 0, "male").when(female > 0, "female").otherwise("none")


def pronoun_gender(text: Column) -> Column:
    return gender_of(pronoun_count(text, "male"), pronoun_count(text, "female"))


def mentions_real_person(text: Column) -> Column:
    return text.rlike(any_case(REAL_PEOPLE))


def legacy_real_person(text: Column) -> Column:
    """Any occurrence, inside longer words too."""
    low = F.lower(text)
    out = F.lit(False)
    for n in LEGACY_REAL_PEOPLE:
        out = out | low.contains(n)
    return out


def is_refusal(text: Column) -> Column:
    return text.rlike(any_case(REFUSALS))


def first_person_anywhere(text: Column) -> Column:
    return text.rlike(FIRST)


def first_person_narration(text: Column) -> Column:
    """First person outside double quotes, straight or curly; texts without any aren't looked at for quotes."""
    return text.rlike(FIRST) & F.regexp_replace(text, QUOTED, " ").rlike(FIRST)


def other_person(text: Column) -> Column:
    return text.rlike(any_case(OTHER_PEOPLE, "s?"))


def non_latin(text: Column) -> Column:
    return text.rlike(NON_LATIN)


def exclusion_reason(text: Column, truncated: Column, male: Column, female: Column, least_pronouns: int = 2, legacy: bool = False) -> Column:
    """The first reason that holds, in this order, or null. The legacy chain has no reason for mixed texts."""
    text = F.coalesce(text, F.lit(""))
    chain = (
        F.when(~text.rlike(r"\S"), "empty")
        .when(F.coalesce(truncated, F.lit(False)), "truncated")
        .when(legacy_real_person(text) if legacy else mentions_real_person(text), "real_person")
        .when(is_refusal(text), "refusal")
        .when(first_person_narration(text), "first_person")
        .when(male + female < least_pronouns, "no_signal")
    )
    return chain if legacy else chain.when((male > 0) & (female > 0), "mixed")


def highlighted(text: Column) -> Column:
    """Pronouns in double square brackets."""
    return F.regexp_replace(text, any_case(MALE_PRONOUNS + FEMALE_PRONOUNS), "[[$0]]")


def article_for(word: Column) -> Column:
    return F.when(F.lower(F.substring(word, 1, 1)).isin(*"aeiou"), "an").otherwise("a")


def match_case(source: Column, target: Column) -> Column:
    """The target in the source's case: all capitals, capitalised or as it is."""
    first = F.substring(source, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    shouted = (F.upper(source) == source) & (F.lower(source) != source) & (F.length(source) > 1)
    return F.when(shouted, F.upper(target)).when(capital, F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30))).otherwise(target)


def prompt_prefix(prompt: Column) -> Column:
    return F.substring_index(prompt, ". Begin", 1)


def length_ratio(a: Column, b: Column) -> Column:
    la, lb = F.greatest(F.length(a), F.lit(1)), F.greatest(F.length(b), F.lit(1))
    return F.greatest(la, lb) / F.least(la, lb)


def tag_step(tag: Column) -> Column:
    """0 for base, N for stepN, null for quantised tags."""
    return F.when(tag == "base", 0).when(tag.rlike(r"^step\d+$"), F.regexp_extract(tag, r"^step(\d+)$", 1).cast("int"))


def model_order(tag: Column) -> tuple[Column, Column]:
    """Sort keys: full-precision tags first, then base, steps by number, unknown ones last."""
    return F.when(tag.endswith("_4bit"), 1).otherwise(0), F.when(tag.startswith("base"), -1).when(tag.rlike(r"^step\d+"), F.regexp_extract(tag, r"^step(\d+)", 1).cast("long")).otherwise(F.lit(10**9))


def variant(spec: Column) -> Column:
    """struct<checkpoint, four_bit, merged> of a variant such as step100_4bit_merged; an error for any other form."""
    form = r"^(base|step\d+)(_4bit(_merged)?)?$"
    return F.when(spec.rlike(form), F.struct(F.regexp_extract(spec, form, 1).alias("checkpoint"), (F.regexp_extract(spec, form, 2) != "").alias("four_bit"), (F.regexp_extract(spec, form, 3) != "").alias("merged"))).otherwise(F.raise_error(F.concat(F.lit("not a model variant: "), spec)))
