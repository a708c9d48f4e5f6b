"""The language rules as functions for SQL text: temporary SQL functions, whose bodies the planner puts in place of the call.

``register(spark)`` makes, for the session:

| function | gives |
|-|-|
| ``pronoun_gender(text)`` | male, female, mixed or none |
| ``exclusion_reason(text, truncated)`` | the first text-level reason, or null |
| ``names_of(text)`` | a table (name, gender, titled), a row for each person named: ``FROM docs, LATERAL names_of(text)`` |
| ``name_list(text)`` | the same as an array of structs |
| ``annotate_text(text, truncated)`` | struct<reason, gender, name, name_gender, usable>, with the name-level reasons |
| ``swap_gender(text, target, name)`` | struct<text, log, fail>: the counterfactual and what was put for what, or the code of why there is none |

All run inside the JVM; the table function becomes one generator over the texts, without a join. They state the rules of ``words``, ``funnel`` and ``swap``, from the same word classes and patterns, and
tests hold both against each other. Names are literals, looked up by hash, so dictionaries of some ten thousand at most.
They can't be called in a lambda. Defined results: a null text has no names (no rows, a null list), pronouns of no gender and
the reason "empty"; swap_gender gives null where any argument is null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ratelens.functions import text as tx
from ratelens.operators import lexicon as lx
from ratelens.operators import swap
from ratelens.operators import words as wd

PART, BREAK = "char(2)", "char(3)"
OWN = r"\x02([MFUpo][^\x02]*)"


def lit(s: str) -> str:
    """A raw literal of a word or pattern."""
    q = '"' if "'" in s else "'"
    if q in s:
        raise ValueError(f"both kinds of quotes in {s!r}")
    return f"r{q}{s}{q}"


def among(x: str, words) -> str:
    return f"coalesce({x} IN ({', '.join(map(lit, sorted(words)))}), false)" if words else "false"


def like(x: str, pattern: str) -> str:
    return f"({x} RLIKE {lit(pattern)})"


def cases(pairs, otherwise: str = "NULL") -> str:
    """A CASE of (condition, result) pairs, the first that holds."""
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def let(name: str, values: dict[str, str], body: str) -> str:
    """The body, in which name.x stands for values that are worked out once."""
    return f"transform(array(named_struct({', '.join(f'{lit(k)}, {v}' for k, v in values.items())})), {name} -> {body})[0]"


# --- words and their marks --------------------------------------------------------------


def word_tag(low: str) -> str:
    return cases([
        *((among(low, words), lit(t)) for t, words in wd.CLASSES),
        (like(low, r"^\p{N}"), "'C'"),
        (f"{low} LIKE '%ly' AND length({low}) > 4", "'Y'"),
        (f"{low} LIKE '%ing' AND length({low}) > 4", "'G'"),
        (f"{low} LIKE '%ed' AND length({low}) > 3", "'B'"),
        (like(low, wd.ADJECTIVE_ENDS), "'J'"),
        (f"{low} LIKE '%s' AND NOT {like(low, wd.SINGULAR_ENDS)}", "'S'"),
    ], "'N'")


def name_kind(word: str, sets: dict[str, tuple[str, ...]]) -> str:
    return cases((among(word, names), lit(k)) for k, names in sets.items())


def gender_of(letter: str) -> str:
    return cases((f"{letter} = '{k}'", f"'{g}'") for k, g in wd.GENDER.items())


def word_mark(sets: dict[str, tuple[str, ...]]) -> str:
    """The mark of the word x at place i of s.w, with s.g before it."""
    near = {"word": "x", "gap": "get(s.g, i)", "before": "get(s.w, i - 1)", "after": "get(s.w, i + 1)", "after_gap": "get(s.g, i + 1)"}
    facts = {
        "title": cases((among("n.word", ts), lit(k)) for k, ts in wd.TITLES.items()),
        "kind": name_kind("n.word", sets),
        "tag": word_tag("lower(n.word)"),
        "after_tag": word_tag("lower(coalesce(n.after, ''))"),
        "everyday": among("lower(n.word)", lx.EVERYDAY),
        "joined": f"NOT {like('n.gap', wd.SIGN)}",
        "starts": f"(i = 0 OR {like('n.gap', wd.SENTENCE)})",
        "joins": f"coalesce(NOT {like('n.after_gap', wd.SIGN)}, false)",
        "before_title": among("n.before", wd.ALL_TITLES),
        "before_name": f"({name_kind('n.before', sets)} IS NOT NULL OR {among('n.before', lx.SURNAMES)})",
        "after_surname": among("n.after", lx.SURNAMES),
        "after_known": f"{name_kind('n.after', sets)} IS NOT NULL",
        "after_capital": f"coalesce({like('n.after', wd.CAPITAL)}, false)",
    }
    kinds = {
        "proper": f"(f.title IS NOT NULL OR (NOT {among('f.tag', wd.CLOSED)} AND (f.kind IS NOT NULL OR (NOT f.starts AND f.tag <> 'Y'))))",
        "after_proper": f"(f.after_capital AND NOT {among('f.after_tag', wd.CLOSED)} AND (f.after_known OR f.after_tag <> 'Y'))",
    }
    acts = "NOT k.after_proper AND f.after_tag IN ('V', 'B')"
    does = "NOT k.after_proper AND (f.after_tag IN ('V', 'B', 'M') OR (f.after_tag = 'S' AND NOT f.starts))"
    person = f"""((k.proper OR NOT {among("f.tag", wd.NEVER_PERSON)}) AND (
      (f.joined AND (f.before_title OR (NOT f.starts AND f.before_name)))
      OR (f.joins AND (f.after_surname OR (k.after_proper AND NOT f.after_known)))
      OR (f.kind IS NOT NULL AND (NOT f.starts OR (f.joins AND NOT f.everyday AND {does})))
      OR (f.starts AND f.joins AND NOT f.everyday AND (k.proper OR f.tag = 'N') AND {acts})))"""
    shown = f"concat(CASE WHEN f.joined THEN '' ELSE {BREAK} END, {PART}, coalesce(f.title, f.kind, CASE WHEN p.person THEN 'p' ELSE 'o' END), x)"
    mark = let("p", {"person": person}, f"CASE WHEN p.person OR (k.proper AND NOT f.everyday) THEN {shown} ELSE {BREAK} END")
    return cases([(like("x", wd.CAPITAL), let("n", near, let("f", facts, let("k", kinds, mark))))], BREAK)


def pieces(text: str) -> dict[str, str]:
    return {"w": f"regexp_extract_all({text}, {lit(wd.PIECE)}, 2)", "g": f"regexp_extract_all({text}, {lit(wd.PIECE)}, 1)"}


def runs(text: str, sets: dict[str, tuple[str, ...]]) -> str:
    """The runs of name parts of a text, as ``words.name_runs`` gives them."""
    marks = let("v", {"t": f"regexp_replace({text}, {lit(wd.QUOTE)}, ' ')"}, let("s", pieces("v.t"), f"array_join(transform(s.w, (x, i) -> {word_mark(sets)}), '')"))
    return f"regexp_extract_all({marks}, {lit(wd.RUN)}, 0)"


def people(runs_: str) -> str:
    """array<struct<name, gender, titled, last>> of runs that name someone, in order."""
    who = lambda name, gender, titled: f"named_struct('name', {name}, 'gender', {gender}, 'titled', {titled}, 'last', CASE WHEN substring(get(a.own, size(a.own) - 1), 2) <> {name} THEN substring(get(a.own, size(a.own) - 1), 2) END)"
    head, last = "substring(get(a.own, 0), 2)", "substring(get(a.own, size(a.own) - 1), 2)"
    parts = {"own": f"regexp_extract_all(r, {lit(OWN)}, 1)", "title": rf"regexp_extract(r, r'\x02([mf])', 1)", "known": r"regexp_extract(r, r'\x02([MFU][^\x02]*)', 1)"}
    letter = "substring(get(a.own, 0), 1, 1)"
    named = cases([
        (f"a.title <> '' AND size(a.own) = 1 AND {letter} <> 'U' AND {letter} <> upper(a.title)", who(head, gender_of("a.title"), "true")),
        ("a.known <> ''", who("substring(a.known, 2)", gender_of("substring(a.known, 1, 1)"), "false")),
        ("size(a.own) > 0 AND a.title <> ''", who(last, gender_of("a.title"), "false")),
        (like("r", r"\x02p"), who(head, "CAST(NULL AS STRING)", "false")),
    ])
    return f"filter(transform({runs_}, r -> {let('a', parts, named)}), q -> q IS NOT NULL)"


def last_gender(found: str) -> str:
    return f"get(reverse(filter({found}, y -> y.gender IS NOT NULL)), 0).gender"


def name_list(text: str, sets) -> str:
    one = f"named_struct('name', o, 'gender', {last_gender('filter(z.p, y -> y.name = o)')}, 'titled', exists(z.p, y -> y.name = o AND y.titled))"
    return let("z", {"p": people(runs(text, sets))}, f"transform(array_distinct(transform(z.p, y -> y.name)), o -> {one})")


# --- reasons ----------------------------------------------------------------------------


def pronouns(text: str, gender: str) -> str:
    return f"regexp_count({text}, {lit(tx.any_case(tx.PRONOUNS[gender]))})"


def pronoun_gender(male: str, female: str) -> str:
    return cases([(f"{male} > 0 AND {female} > 0", "'mixed'"), (f"{male} > 0", "'male'"), (f"{female} > 0", "'female'")], "'none'")


def text_reason(t: str, truncated: str, male: str, female: str, least: int = 2) -> str:
    first = lit(tx.FIRST)
    return cases([
        (rf"NOT ({t} RLIKE r'\S')", "'empty'"),
        (f"coalesce({truncated}, false)", "'truncated'"),
        (like(t, tx.any_case(tx.REAL_PEOPLE)), "'real_person'"),
        (like(t, tx.any_case(tx.REFUSALS)), "'refusal'"),
        (f"{t} RLIKE {first} AND regexp_replace({t}, {lit(tx.QUOTED)}, ' ') RLIKE {first}", "'first_person'"),
        (f"{male} + {female} < {least}", "'no_signal'"),
        (f"{male} > 0 AND {female} > 0", "'mixed'"),
    ])


def counted(text: str) -> dict[str, str]:
    return {"t": f"coalesce({text}, '')"} | {g: pronouns(f"coalesce({text}, '')", g) for g in tx.PRONOUNS}


def annotation(text: str, truncated: str, sets) -> str:
    """Text-level reasons, then, of texts without one only, name-level reasons."""
    first = text_reason("c.t", truncated, "c.male", "c.female")
    gender = pronoun_gender("c.male", "c.female")
    whose = {"n": "size(array_distinct(transform(z.p, y -> y.name)))", "name": "get(z.p, 0).name", "gender": last_gender("z.p")}
    reason = cases([("e.reason IS NOT NULL", "e.reason"), ("u.n = 0", "'no_name'"), ("u.n > 1", "'multi_person'"), ("u.gender IS NULL", "'unknown_name'"), ("u.gender <> 'unisex' AND u.gender <> e.gender", "'name_pronoun_mismatch'")])
    out = let("b", {"reason": reason}, "named_struct('reason', b.reason, 'gender', e.gender, 'name', CASE WHEN u.n = 1 THEN u.name END, 'name_gender', CASE WHEN u.n = 1 THEN u.gender END, 'usable', b.reason IS NULL)")
    named = let("z", {"p": people(runs("e.t", sets))}, let("u", whose, out))
    told = let("d", {"reason": first}, let("e", {"reason": "d.reason", "gender": f"CASE WHEN d.reason IS NULL THEN {gender} END", "t": "CASE WHEN d.reason IS NULL THEN c.t END"}, named))
    return let("c", counted(text), told)


# --- the swap ---------------------------------------------------------------------------


def matched_case(source: str, target: str) -> str:
    return cases([
        (f"upper({source}) = {source} AND lower({source}) <> {source} AND length({source}) > 1", f"upper({target})"),
        (f"upper(substring({source}, 1, 1)) = substring({source}, 1, 1) AND lower(substring({source}, 1, 1)) <> substring({source}, 1, 1)", f"concat(upper(substring({target}, 1, 1)), substring({target}, 2))"),
    ], target)


def tags_of(s: str) -> str:
    """Two letters a word of s.w, as ``swap.tag_string`` has them."""
    between = cases([(f"NOT {like('b.gap', wd.SIGN)}", "' '"), ("b.gap = '-'", "'-'")], "'|'")
    proper = f"({like('x', wd.CAPITAL)} AND NOT {among('b.tag', wd.CLOSED)} AND i > 0 AND NOT {like('b.gap', wd.SENTENCE)} AND b.tag <> 'Y') OR {among('x', wd.ALL_TITLES)}"
    one = let("b", {"gap": f"get({s}.g, i)", "tag": word_tag("lower(x)")}, f"concat({between}, CASE WHEN {proper} THEN 'P' ELSE b.tag END)")
    return f"array_join(transform({s}.w, (x, i) -> {one}), '')"


def possessive() -> str:
    to_do = "coalesce(lower(get(s.w, i + 1)) = 'to' AND get(s.g, i + 2) = '-' AND lower(get(s.w, i + 2)) = 'do', false)"
    return f"({to_do} OR {like('substring(h.tags, i * 2 + 3)', swap.NOUN_AFTER_HER)})"


def edit() -> str:
    """What stands for the word x at place i of s.w; m holds the target, the old and new name and the protagonist's names."""
    titles = [(f"m.target = '{to}' AND x = '{a}{dot}' AND array_contains(m.own, get(s.w, i + 1))", f"'{b}{dot}'") for to, ts in lx.TITLE_TO.items() for a, b in ts.items() for dot in ("", ".")]
    fixed = [(f"m.target = '{to}' AND {among('lower(x)', ps)}", cases((f"lower(x) = {lit(a)}", matched_case("x", lit(b))) for a, b in ps.items())) for to, ps in swap.FIXED.items()]
    his = cases([(like("substring(h.tags, i * 2 + 3)", swap.AFTER_HIS), matched_case("x", "'her'"))], matched_case("x", "'hers'"))
    her = cases([(possessive(), matched_case("x", "'his'"))], matched_case("x", "'him'"))
    return cases([("x = m.old", "m.name"), *titles, *fixed, ("m.target = 'female' AND lower(x) = 'his'", his), ("m.target = 'male' AND lower(x) = 'her'", her)], "x")


def without_middle_names(text: str, runs_: str, name: str) -> str:
    """struct<text, gone>: the text with male and female names between the protagonist's first and last name left out, and which."""
    cut = {"parts": f"regexp_extract_all(r, {lit(OWN)}, 1)"}
    at = {"parts": "j.parts", "at": f"array_position(transform(j.parts, y -> substring(y, 2)), {name})"}
    after = {"after": "slice(l.parts, CAST(greatest(l.at + 1, 1) AS INT), CAST(greatest(size(l.parts) - l.at, 0) AS INT))"}
    gone = "CASE WHEN k < size(d.after) - 1 THEN substring(y, 1, 1) IN ('M', 'F') ELSE false END"
    short = f"concat_ws(' ', {name}, transform(filter(d.after, (y, k) -> NOT {gone}), y -> substring(y, 2)))"
    whole = f"concat_ws(' ', {name}, transform(d.after, y -> substring(y, 2)))"
    out = {"gone": f"transform(filter(d.after, (y, k) -> {gone}), y -> substring(y, 2))", "whole": whole, "short": short}
    does = "l.at > 0 AND size(v.gone) > 0 AND contains(acc.text, v.whole)"
    done = f"CASE WHEN {does} THEN named_struct('text', replace(acc.text, v.whole, v.short), 'gone', array_union(acc.gone, v.gone)) ELSE acc END"
    step = let("j", cut, let("l", at, let("d", after, let("v", out, done))))
    own = rf"filter({runs_}, r -> contains(regexp_replace(r, r'\x02[a-zA-Z]', char(2)), concat(char(2), {name})))"
    return f"aggregate({own}, named_struct('text', {text}, 'gone', CAST(array() AS ARRAY<STRING>)), (acc, r) -> {step})"


def counterfactual(text: str, target: str, name: str, sets) -> str:
    all_names = [n for ns in sets.values() for n in ns]
    lasts = "array_distinct(filter(transform(z.p, y -> y.last), y -> y IS NOT NULL))"
    who = {"n": "size(array_distinct(transform(z.p, y -> y.name)))", "name": "get(z.p, 0).name", "gender": last_gender("z.p"), "titled": "exists(z.p, y -> y.titled)", "lasts": lasts}
    stays = f"u.gender = 'unisex' OR u.titled OR NOT {among('u.name', all_names)}"
    asked = {"target": target, "name": name, "old": f"CASE WHEN NOT coalesce({stays}, false) THEN u.name END", "own": "array_union(array(u.name), u.lasts)", "cut": without_middle_names(text, "z.r", "u.name")}
    tail = "substring(m.cut.text, 1 + length(array_join(transform(s.w, (x, i) -> concat(s.g[i], x)), '')))"
    edits = {"to": f"transform(s.w, (x, i) -> {edit()})"}
    made = {"t": f"concat(array_join(transform(t0.to, (x, i) -> concat(s.g[i], x)), ''), {tail})"}
    pair = lambda a, b: f"named_struct('old', {a}, 'new', {b})"
    log = f"concat(transform(m.cut.gone, x -> {pair('x', lit(''))}), filter(transform(s.w, (x, i) -> {pair('x', 't0.to[i]')}), x -> x.old <> x.new))"
    wrong = f"CASE WHEN m.target = 'female' THEN array({', '.join(map(lit, wd.TITLES['m']))}) ELSE array({', '.join(map(lit, wd.TITLES['f']))}) END"
    after = {"words": f"regexp_extract_all(o.t, {lit(wd.PIECE)}, 2)", "p": people(runs("o.t", sets)), "wrong": wrong, "before": f"{pronouns(text, 'male')} + {pronouns(text, 'female')}"} | {g: pronouns("o.t", g) for g in tx.PRONOUNS}
    two = f"lower(x) = 'her' AND i > 0 AND {among('lower(get(s.w, i - 1))', swap.two_object_forms())} AND NOT {like('s.g[i]', wd.SIGN)} AND {possessive()}"
    fail = cases([
        ("u.gender IS NULL", "'unknown_name'"),
        (like(text, tx.any_case(tuple(sorted(lx.PERSON_NOUNS)))), "'person_noun'"),
        (f"m.target = 'male' AND exists(transform(s.w, (x, i) -> {two}), y -> y)", "'ambiguous_her'"),
        ("CASE m.target WHEN 'male' THEN a2.female ELSE a2.male END > 0 OR CASE m.target WHEN 'male' THEN a2.male ELSE a2.female END <> a2.before", "'pronoun_check_failed'"),
        ("m.old IS NOT NULL AND exists(a2.p, y -> y.name = m.old)", "'name_not_replaced'"),
        ("exists(a2.p, y -> coalesce(y.gender, 'none') NOT IN ('unisex', m.target))", "'name_check_failed'"),
        ("exists(transform(a2.words, (x, i) -> array_contains(a2.wrong, x) AND coalesce(array_contains(array_union(m.own, array(m.name)), get(a2.words, i + 1)), false)), y -> y)", "'title_check_failed'"),
    ])
    result = f"named_struct('text', CASE WHEN e.fail IS NULL THEN o.t END, 'log', CASE WHEN e.fail IS NULL THEN {log} END, 'fail', e.fail)"
    judged = let("t0", edits, let("o", made, let("a2", after, let("e", {"fail": fail}, result))))
    one = let("m", asked, let("s", pieces("m.cut.text"), let("h", {"tags": tags_of("s")}, judged)))
    chosen = cases([("u.n = 1", one)], "named_struct('text', CAST(NULL AS STRING), 'log', CAST(NULL AS ARRAY<STRUCT<old: STRING, new: STRING>>), 'fail', 'not_single_name')")
    found = let("y0", {"r": runs(text, sets)}, let("z", {"r": "y0.r", "p": people("y0.r")}, let("u", who, chosen)))
    return cases([(f"{text} IS NOT NULL AND {target} IS NOT NULL AND {name} IS NOT NULL", found)])


# --- making them ------------------------------------------------------------------------


def functions(names: dict[str, str] | None = None) -> dict[str, tuple[str, str, str]]:
    """Name to (parameters, type, body)."""
    sets = wd.by_gender(names)
    return {
        "pronoun_gender": ("txt STRING", "STRING", let("c", counted("txt"), pronoun_gender("c.male", "c.female"))),
        "exclusion_reason": ("txt STRING, cut BOOLEAN", "STRING", let("c", counted("txt"), text_reason("c.t", "cut", "c.male", "c.female"))),
        "names_of": ("txt STRING", "TABLE(name STRING, gender STRING, titled BOOLEAN)", f"SELECT inline({name_list('txt', sets)})"),
        "name_list": ("txt STRING", "ARRAY<STRUCT<name: STRING, gender: STRING, titled: BOOLEAN>>", name_list("txt", sets)),
        "annotate_text": ("txt STRING, cut BOOLEAN", "STRUCT<reason: STRING, gender: STRING, name: STRING, name_gender: STRING, usable: BOOLEAN>", annotation("txt", "cut", sets)),
        "swap_gender": ("txt STRING, to_gender STRING, to_name STRING", "STRUCT<text: STRING, log: ARRAY<STRUCT<old: STRING, new: STRING>>, fail: STRING>", counterfactual("txt", "to_gender", "to_name", sets)),
    }


def register(spark: SparkSession, names: dict[str, str] | None = None) -> list[str]:
    """Makes the functions for this session, over the given dictionary of names (name to gender) or the default one."""
    made = functions(names)
    for name, (parameters, kind, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return list(made)
