"""Words of English texts and the people they name, as columns: no Python function sees a text.

A text is a list of words, each with the gap of signs and spaces before it. A word's tag is one letter, from closed
word classes and endings; whether a capitalised word is part of a name depends on it and its two neighbours. Marks of
all words are joined to one string, in which runs of name parts are what lies between breaks, so that names come out of
a few passes over a row, without a shuffle and without a window. ``token_table`` and what follows give the same as rows, for
dictionaries too large for a literal: one broadcast (or shuffled) join with a names table, and runs as gaps and islands.

Quotes hide what is inside: a quotation mark opens where none is open and closes where one is; curly ones open and close.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratelens.operators import lexicon as lx

#: A word is a title with its full stop, letters with an apostrophe and three letters or more after it, or digits.
WORD = r"(?:Mrs|Mr|Ms|Dr|Prof)\.|\p{L}+(?:['’]\p{L}{3,})?|\p{N}+"
PIECE = rf"([^\p{{L}}\p{{N}}]*)({WORD})"
QUOTE = r'["“][^"”]*(?:["”]|\z)'
#: Something else than white space.
SIGN = r"[^\x09-\x0D\x20]"
CAPITAL = r"^\p{Lu}"
SENTENCE = r"[.!?]"
TITLES = {"m": ("Mr", "Mr."), "f": ("Mrs", "Mrs.", "Ms", "Ms.", "Miss"), "t": ("Dr", "Dr.", "Prof", "Prof.", "Sir", "Madam", "Mx")}
ALL_TITLES = tuple(t for ts in TITLES.values() for t in ts)
GENDER = {"M": "male", "F": "female", "U": "unisex", "m": "male", "f": "female"}
#: Tags by closed classes, in order; then C digits, Y in -ly, G in -ing, B in -ed, J by ending, S plural, N other, P names.
CLASSES = (("D", lx.DETERMINERS), ("I", lx.PREPOSITIONS), ("K", lx.CONJUNCTIONS), ("M", lx.AUXILIARIES), ("R", lx.PRONOUNS | {"his", "her"}), ("A", lx.ADVERBS), ("J", lx.ADJECTIVES), ("V", lx.VERBS))
ADJECTIVE_ENDS = "(?:ful|ous|ive|able|ible|less|ish)$"
SINGULAR_ENDS = "(?:ss|us|is)$"
CLOSED, NEVER_PERSON = "DIKMRAV", "DIKMRAY"
BREAK, PART = "\x03", "\x02"
RUN = r"\x02[^\x03]*"


def by_gender(names: dict[str, str] | None) -> dict[str, tuple[str, ...]]:
    """Names of the dictionary by their letter: M, F or U."""
    names = names or lx.default_names()
    return {k: tuple(sorted(n for n, g in names.items() if g == GENDER[k])) for k in "MFU"}


def known_kind(word: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """M, F or U where the word is a name of the dictionary, else null. Sets of literals are looked up by hash."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, ns in names.items():
        if ns:
            out = out.when(word.isin(*ns), k)
    return out


def has_tag(tag: Column, letters: str) -> Column:
    return tag.isin(*letters)


def word_tag(low: Column) -> Column:
    """The tag of a word by itself, from its lower case."""
    closed = F.when(F.lit(False), "")
    for t, words in CLASSES:
        closed = closed.when(low.isin(*sorted(words)), t)
    return (
        F.when(low.isin(*sorted({w for _, words in CLASSES for w in words})), closed)
        .when(low.rlike(r"^\p{N}"), "C")
        .when(low.endswith("ly") & (F.length(low) > 4), "Y")
        .when(low.endswith("ing") & (F.length(low) > 4), "G")
        .when(low.endswith("ed") & (F.length(low) > 3), "B")
        .when(low.rlike(ADJECTIVE_ENDS), "J")
        .when(low.endswith("s") & ~low.rlike(SINGULAR_ENDS), "S")
        .otherwise("N")
    )


def facts(f: Callable[[str], Column], names: dict[str, tuple[str, ...]] | None) -> dict[str, Column]:
    """What a word's mark depends on, from it, its neighbours and the gaps; without names, from their kinds too."""
    no = lambda c: F.coalesce(c, F.lit(False))
    kind = lambda n: known_kind(f(n), names) if names is not None else f(f"{n}_kind")
    title = F.lit(None).cast("string")
    for k, ts in TITLES.items():
        title = F.when(f("word").isin(*ts), k).otherwise(title)
    return {
        "word": f("word"),
        "kind": kind("word"),
        "title": title,
        "tag": word_tag(f("low")),
        "everyday": f("low").isin(*sorted(lx.EVERYDAY)),
        "joined": ~f("gap").rlike(SIGN),
        "starts": f("first") | f("gap").rlike(SENTENCE),
        "before_title": no(f("before").isin(*ALL_TITLES)),
        "before_name": kind("before").isNotNull() | no(f("before").isin(*sorted(lx.SURNAMES))),
        "joins": no(~f("after_gap").rlike(SIGN)),
        "after_capital": no(f("after").rlike(CAPITAL)),
        "after_surname": no(f("after").isin(*sorted(lx.SURNAMES))),
        "after_known": kind("after").isNotNull(),
        "after_tag": word_tag(f("after_low")),
    }


def let(values: dict[str, Column], body: Callable[[Callable[[str], Column]], Column]) -> Column:
    """The body over values that are worked out once, within a row's function too."""
    bound = F.array(F.struct(*(c.alias(n) for n, c in values.items())))
    return F.get(F.transform(bound, lambda x: body(lambda n: x[n])), F.lit(0))


def mark(f: Callable[[str], Column]) -> Column:
    """A word's mark from its facts: a break, or where it is part of a name, its kind and the word.

    Kinds are the titles' m, f, t, the dictionary's M, F, U, p for another person and o for what else is part of a name.
    Neighbours count where only white space lies between.
    """
    tag, after_tag, starts, known = f("tag"), f("after_tag"), f("starts"), f("kind").isNotNull()
    proper = f("title").isNotNull() | (~has_tag(tag, CLOSED) & (known | (~starts & (tag != "Y"))))
    after_proper = f("after_capital") & ~has_tag(after_tag, CLOSED) & (f("after_known") | (after_tag != "Y"))
    followed = f("after_surname") | (after_proper & ~f("after_known"))
    acting = ~after_proper & has_tag(after_tag, "VB")
    doing = acting | (~after_proper & ((after_tag == "M") | ((after_tag == "S") & ~starts)))
    person = (proper | ~has_tag(tag, NEVER_PERSON)) & (
        (f("joined") & (f("before_title") | (~starts & f("before_name"))))
        | (f("joins") & followed)
        | (known & (~starts | (f("joins") & doing & ~f("everyday"))))
        | (starts & (proper | (tag == "N")) & f("joins") & acting & ~f("everyday"))
    )
    own = F.coalesce(f("title"), f("kind"), F.when(person, "p").otherwise("o"))
    shown = F.concat(F.when(f("joined"), F.lit(PART)).otherwise(F.lit(BREAK + PART)), own, f("word"))
    return F.when(person | (proper & ~f("everyday")), shown).otherwise(F.lit(BREAK))


# --- in a row -----------------------------------------------------------------------------


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, added and worked out once: a generator keeps what follows from repeating their making.

    A column that others are to filter by is added so, too: a filter over a plain column of a generator's inputs
    would be moved below the generator, where the planner has dropped them.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def visible(text: Column) -> Column:
    """The text without what is in quotes."""
    return F.regexp_replace(text, QUOTE, " ")


def quoted(text: Column) -> Column:
    """The quotations of a text, with their marks."""
    return F.regexp_extract_all(text, F.lit(QUOTE), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(2))


def gaps(text: Column) -> Column:
    """What stands before each word."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))


def marks(w: Column, g: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """The marks of all words, joined; from the words and gaps of a text."""

    def one(word: Column, i: Column) -> Column:
        after = F.get(w, i + 1)
        near = {"word": word, "low": F.lower(word), "gap": F.get(g, i), "first": i == 0, "before": F.get(w, i - 1), "after": after, "after_low": F.lower(F.coalesce(after, F.lit(""))), "after_gap": F.get(g, i + 1)}
        return F.when(word.rlike(CAPITAL), let(near, lambda f: let(facts(f, names), mark))).otherwise(F.lit(BREAK))

    return F.array_join(F.transform(w, one), "")


def name_runs(marked: Column) -> Column:
    """Maximal runs of name parts, each its parts with a mark and their kind before them."""
    return F.regexp_extract_all(marked, F.lit(RUN), F.lit(0))


def run_text(run: Column) -> Column:
    """The words of a run, titles too, between spaces."""
    return F.regexp_replace(F.substring(run, 3, 1 << 30), r"\x02.", " ")


def _gender(letter: Column) -> Column:
    out = F.when(F.lit(False), "")
    for k, g in GENDER.items():
        out = out.when(letter == k, g)
    return out


def named(run: Column) -> Column:
    """struct<name, gender, titled, last>: who a run names, or null.

    In order: one surname after a gendered title has the title's gender; else the first name of the dictionary its own;
    else the last word after a gendered title that gender; else a person's first word none. last: the run's last word where
    it isn't the name.
    """
    own = F.regexp_extract_all(run, F.lit(r"\x02([MFUpo][^\x02]*)"), F.lit(1))
    title, first_known = F.regexp_extract(run, r"\x02([mf])", 1), F.regexp_extract(run, r"\x02([MFU][^\x02]*)", 1)
    letter, word = (lambda x: F.substring(x, 1, 1)), (lambda x: F.substring(x, 2, 1 << 30))
    head, last = F.get(own, F.lit(0)), F.get(own, F.size(own) - 1)
    surname = (title != "") & (F.size(own) == 1) & ~letter(head).isin("U") & (letter(head) != F.upper(title))
    case = lambda name, gender, titled: F.struct(name.alias("name"), gender.alias("gender"), F.lit(titled).alias("titled"), F.when(word(last) != name, word(last)).alias("last"))
    return (
        F.when(surname, case(word(head), _gender(title), True))
        .when(first_known != "", case(word(first_known), _gender(letter(first_known)), False))
        .when((F.size(own) > 0) & (title != ""), case(word(last), _gender(title), False))
        .when(run.rlike(r"\x02p"), case(word(head), F.lit(None).cast("string"), False))
    )


def people(runs: Column) -> Column:
    """array<struct<name, gender, titled, last>> of the runs that name someone, in order."""
    return F.filter(F.transform(runs, named), lambda p: p.isNotNull())


def summary(found: Column) -> Column:
    """struct<n, name, gender, titled, lasts> of people: how many names, and where there is one, who.

    A name's gender is the last that isn't null.
    """
    n = F.size(F.array_distinct(F.transform(found, lambda p: p["name"])))
    sure = F.filter(found, lambda p: p["gender"].isNotNull())
    lasts = F.array_distinct(F.filter(F.transform(found, lambda p: p["last"]), lambda x: x.isNotNull()))
    one = lambda c: F.when(n == 1, c)
    return F.struct(n.alias("n"), one(F.get(found, F.lit(0))["name"]).alias("name"), one(F.get(sure, F.size(sure) - 1)["gender"]).alias("gender"), one(F.exists(found, lambda p: p["titled"])).alias("titled"), one(lasts).alias("lasts"))


def with_people(df: DataFrame, text: Column, out: str = "who", names: dict[str, str] | None = None, keep_runs: bool = False) -> DataFrame:
    """Adds a struct of whom the text names (``summary``); a null text gives a null struct and costs nothing.

    keep_runs: also <out>_runs, the runs of name parts.
    """
    sets, own = by_gender(names), f"_{out}"
    shown = held(df, **{f"{own}_v": visible(text)})
    shown = held(shown.withColumns({f"{own}_w": words(F.col(f"{own}_v")), f"{own}_g": gaps(F.col(f"{own}_v"))}), **{f"{own}_m": marks(F.col(f"{own}_w"), F.col(f"{own}_g"), sets)})
    shown = held(shown, **{f"{out}_runs": name_runs(F.col(f"{own}_m"))})
    shown = held(shown, **{f"{own}_p": people(F.col(f"{out}_runs"))})
    shown = held(shown, **{out: F.when(F.col(f"{own}_p").isNotNull(), summary(F.col(f"{own}_p")))})
    return shown.drop(*(f"{own}_{x}" for x in "vwgmp"), *([] if keep_runs else [f"{out}_runs"]))


# --- as rows ------------------------------------------------------------------------------

#: A names table of up to so many rows is broadcast; a larger one is joined by a shuffle of the capitalised words.
BROADCAST_NAMES = 200_000


def token_table(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The key, place, gap, word, and quoted of every word; words in quotes are of quoted, others of the rest.

    Places count visible words from 0, so that a quoted nickname doesn't part the words around it.
    """
    rows = texts.select(*key, F.col(text).alias("_t"))
    seen = rows.select(*key, F.lit(False).alias("quoted"), F.posexplode(F.arrays_zip(gaps(visible(F.col("_t"))).alias("gap"), words(visible(F.col("_t"))).alias("word"))).alias("place", "z"))
    inner = rows.select(*key, F.lit(True).alias("quoted"), F.posexplode(words(F.array_join(quoted(F.col("_t")), " "))).alias("place", "word"))
    return seen.select(*key, "quoted", "place", "z.gap", "z.word").unionByName(inner.select(*key, "quoted", "place", F.lit(None).cast("string").alias("gap"), "word"))


def name_parts(tokens: DataFrame, key: list[str], names: DataFrame, n_names: int | None = None) -> DataFrame:
    """The visible words that are part of a name: key, place, kind, word and run, the number of their run.

    names: a table (name, name_gender) of any size; only capitalised words and the one beside them meet it. Runs are
    islands: a part's place minus its number among the parts stays the same within one, and a sign before it begins another.
    """
    order = Window.partitionBy(*key).orderBy("place")
    shown = tokens.filter("not quoted")
    table = names.select(F.col("name").alias("word"), F.when(F.col("name_gender") == "male", "M").when(F.col("name_gender") == "female", "F").otherwise("U").alias("kind")).dropDuplicates(["word"])
    if (table.count() if n_names is None else n_names) <= BROADCAST_NAMES:
        table = F.broadcast(table)
    rows = shown.join(table, "word", "left")
    beside = {"before": F.lag("word"), "before_kind": F.lag("kind"), "after": F.lead("word"), "after_kind": F.lead("kind"), "after_gap": F.lead("gap")}
    rows = rows.withColumns({n: c.over(order) for n, c in beside.items()}).filter(F.col("word").rlike(CAPITAL)).withColumnRenamed("kind", "word_kind")
    rows = rows.withColumns({"low": F.lower("word"), "after_low": F.lower(F.coalesce("after", F.lit(""))), "first": F.col("place") == 0})
    known = held(rows.select(*key, "place", F.struct(*(c.alias(n) for n, c in facts(F.col, None).items())).alias("f")), mark=mark(lambda n: F.col("f")[n]))
    parts = known.filter(F.col("mark") != BREAK).select(*key, "place", "f.word", "mark")
    parts = parts.withColumns({"kind": F.regexp_extract("mark", r"\x02(.)", 1), "new": F.col("mark").startswith(BREAK)})
    island = F.col("place") - F.row_number().over(order)
    parts = parts.withColumn("island", island).withColumn("begins", (F.col("new") | F.coalesce(F.lag("island").over(order) != F.col("island"), F.lit(True))).cast("int"))
    return parts.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*key, "place", "kind", "word", "run")


def span_table(parts: DataFrame, key: list[str]) -> DataFrame:
    """One row a run: key, run, place of its first part, marked (its parts and kinds) and span (its words)."""
    listed = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit(PART), "kind", "word").alias("m"))))
    out = parts.groupBy(*key, "run").agg(F.min("place").alias("place"), F.array_join(F.transform(listed, lambda x: x["m"]), "").alias("marked"))
    return out.withColumn("span", run_text(F.col("marked")))


def people_table(spans: DataFrame, key: list[str]) -> DataFrame:
    """key, name, gender, titled: one row a name of a text; its gender is the last that isn't null."""
    rows = spans.withColumn("p", named(F.col("marked"))).filter("p is not null")
    sure = F.when(F.col("p.gender").isNotNull(), F.struct("place", F.col("p.gender").alias("gender")))
    return rows.groupBy(*key, F.col("p.name").alias("name")).agg(F.max(sure)["gender"].alias("gender"), F.max("p.titled").alias("titled"))

