"""Registered queries of the language rules, over whole tables: tags, quotes, spans, names, pronouns, swaps.

The SQL states the same rules with windows over unnested words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ratelens.functions import sqltext
from ratelens.functions import text as tx
from ratelens.functions.rng import draw
from ratelens.operators import funnel as fn
from ratelens.operators import lexicon, pairs, swap
from ratelens.operators import lexicon as lx
from ratelens.operators import words as wd
from ratelens.plans import completions as data
from ratelens.plans.catalog import _CALIBRATION, KEY, SEED, oracle_sql_of, query
from ratelens.sources import files

# --- the rules in SQL -------------------------------------------------------------------


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(x: str, words) -> str:
    return f"coalesce({x} IN ({', '.join(map(quote, sorted(words)))}), false)"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {quote(pattern)})"


def tag_sql(low: str) -> str:
    closed = " ".join(f"WHEN {among(low, ws)} THEN '{t}'" for t, ws in wd.CLASSES)
    return f"""CASE {closed} WHEN {matches(low, r"^\p{N}")} THEN 'C' WHEN {low} LIKE '%ly' AND length({low}) > 4 THEN 'Y' WHEN {low} LIKE '%ing' AND length({low}) > 4 THEN 'G' WHEN {low} LIKE '%ed' AND length({low}) > 3 THEN 'B'
      WHEN {matches(low, wd.ADJECTIVE_ENDS)} THEN 'J' WHEN {low} LIKE '%s' AND NOT {matches(low, wd.SINGULAR_ENDS)} THEN 'S' ELSE 'N' END"""


def kind_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {among(x, ns)} THEN '{k}'" for k, ns in wd.by_gender(None).items()) + " END"


def people_sql(source: str, key: str, text: str, name: str) -> str:
    """WITH clauses <name>_tokens (place, gap, word, mark of visible words), <name>_runs (run, marked) and <name>_people (run, name, gender, titled, last)."""
    has = lambda tag, letters: f"{tag} IN ({', '.join(map(repr, letters))})"
    title = " ".join(f"WHEN {among('word', ts)} THEN '{k}'" for k, ts in wd.TITLES.items())
    gender = lambda x: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{g}'" for k, g in wd.GENDER.items()) + " END"
    return rf""", {name}_tokens AS (
  SELECT {key}, unnest(range(len(w))) AS place, unnest(w) AS word, unnest(g) AS gap
  FROM (SELECT {key}, regexp_extract_all(v, {quote(wd.PIECE)}, 2) AS w, regexp_extract_all(v, {quote(wd.PIECE)}, 1) AS g FROM (SELECT {key}, regexp_replace({text}, {quote(wd.QUOTE)}, ' ', 'g') AS v FROM {source}))
), {name}_near AS (
  SELECT *, lag(word) OVER o AS before, lead(word) OVER o AS after, lead(gap) OVER o AS after_gap FROM {name}_tokens WINDOW o AS (PARTITION BY {key} ORDER BY place)
), {name}_facts AS (
  SELECT *, {matches("word", wd.CAPITAL)} AS capital, {kind_sql("word")} AS kind, CASE {title} END AS title, {tag_sql("lower(word)")} AS tag, {among("lower(word)", lx.EVERYDAY)} AS everyday, NOT {matches("gap", wd.SIGN)} AS joined,
    place = 0 OR {matches("gap", wd.SENTENCE)} AS starts, {among("before", wd.ALL_TITLES)} AS before_title, {kind_sql("before")} IS NOT NULL OR {among("before", lx.SURNAMES)} AS before_name,
    coalesce(NOT {matches("after_gap", wd.SIGN)}, false) AS joins, coalesce({matches("after", wd.CAPITAL)}, false) AS after_capital, {among("after", lx.SURNAMES)} AS after_surname, {kind_sql("after")} IS NOT NULL AS after_known, {tag_sql("lower(coalesce(after, ''))")} AS after_tag
  FROM {name}_near
), {name}_proper AS (
  SELECT *, title IS NOT NULL OR (NOT {has("tag", wd.CLOSED)} AND (kind IS NOT NULL OR (NOT starts AND tag <> 'Y'))) AS proper,
    after_capital AND NOT {has("after_tag", wd.CLOSED)} AND (after_known OR after_tag <> 'Y') AS after_proper FROM {name}_facts WHERE capital
), {name}_persons AS (
  SELECT *, (proper OR NOT {has("tag", wd.NEVER_PERSON)}) AND ((joined AND (before_title OR (NOT starts AND before_name))) OR (joins AND (after_surname OR (after_proper AND NOT after_known)))
      OR (kind IS NOT NULL AND (NOT starts OR (joins AND NOT everyday AND NOT after_proper AND (after_tag IN ('V', 'B', 'M') OR (after_tag = 'S' AND NOT starts)))))
      OR (starts AND (proper OR tag = 'N') AND joins AND NOT after_proper AND after_tag IN ('V', 'B') AND NOT everyday)) AS person FROM {name}_proper
), {name}_parts AS (
  SELECT {key}, place, chr(2) || coalesce(title, kind, CASE WHEN person THEN 'p' ELSE 'o' END) || word AS mark, joined FROM {name}_persons WHERE person OR (proper AND NOT everyday)
), {name}_islands AS (
  SELECT *, sum((NOT joined OR island IS DISTINCT FROM last_island)::INT) OVER o AS run
  FROM (SELECT *, lag(island) OVER o AS last_island FROM (SELECT *, place - row_number() OVER o AS island FROM {name}_parts WINDOW o AS (PARTITION BY {key} ORDER BY place)) WINDOW o AS (PARTITION BY {key} ORDER BY place))
  WINDOW o AS (PARTITION BY {key} ORDER BY place ROWS UNBOUNDED PRECEDING)
), {name}_runs AS (
  SELECT {key}, run, string_agg(mark, '' ORDER BY place) AS marked FROM {name}_islands GROUP BY ALL
), {name}_cut AS (
  SELECT *, regexp_extract(marked, '\x02([mf])', 1) AS tg, regexp_extract(marked, '\x02([MFU][^\x02]*)', 1) AS known, regexp_extract_all(marked, '\x02([MFUpo][^\x02]*)', 1) AS own FROM {name}_runs
), {name}_named AS (
  SELECT *, CASE WHEN tg <> '' AND len(own) = 1 AND own[1][1] <> 'U' AND own[1][1] <> upper(tg) THEN 1 WHEN known <> '' THEN 2 WHEN len(own) > 0 AND tg <> '' THEN 3 WHEN {matches("marked", chr(2) + "p")} THEN 4 END AS how FROM {name}_cut
), {name}_people AS (
  SELECT {key}, run, name, gender, how = 1 AS titled, CASE WHEN own[-1][2:] <> name THEN own[-1][2:] END AS last
  FROM (SELECT *, CASE how WHEN 2 THEN known[2:] WHEN 3 THEN own[-1][2:] ELSE own[1][2:] END AS name, CASE how WHEN 2 THEN {gender("known[1]")} WHEN 4 THEN NULL ELSE {gender("tg")} END AS gender FROM {name}_named WHERE how IS NOT NULL)
), {name}_names AS (
  SELECT {key}, name, arg_max(gender, run) FILTER (gender IS NOT NULL) AS gender, bool_or(titled) AS titled FROM {name}_people GROUP BY {key}, name
)"""


def final_sql(where: str = "") -> str:
    """WITH clauses up to <final>: labelled with the name-level reasons, of the completions that pass the condition."""
    key = ", ".join(KEY)
    return f""", survivors AS (SELECT * FROM labelled WHERE reason IS NULL{" AND " + where if where else ""}){people_sql("survivors", key, "completion", "t")},
who AS (SELECT {key}, count(*) AS n, CASE WHEN count(*) = 1 THEN min(name) END AS found, CASE WHEN count(*) = 1 THEN min(gender) END AS found_gender, bool_or(titled) AS titled FROM t_names GROUP BY ALL),
final AS (SELECT l.* EXCLUDE (name, reason, usable), found AS name, found_gender AS name_gender, reason_ AS reason, reason_ IS NULL AS usable, titled
  FROM (SELECT l.*, found, found_gender, titled, CASE WHEN reason IS NOT NULL THEN reason WHEN coalesce(n, 0) = 0 THEN 'no_name' WHEN n > 1 THEN 'multi_person' WHEN found_gender IS NULL THEN 'unknown_name'
    WHEN found_gender <> 'unisex' AND found_gender <> gender THEN 'name_pronoun_mismatch' END AS reason_ FROM labelled l LEFT JOIN who USING ({key}){" WHERE " + where if where else ""}) l)
"""


# --- tags, quotes, spans, names of documents --------------------------------------------


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


_DOCS = "/* documents */ WITH docs AS (SELECT doc_id, text FROM documents)"


def signs_sql(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[\x09-\x0D\x20]+', '', 'g'), '({wd.SIGN})', '\1:X ', 'g')"


#: Pronouns that are possessive before what is someone's; "her" has a rule of its own.
POSSESSIVE = ("his", "my", "their", "its", "your", "our", "whose")


@query(lambda: f"""{_DOCS}, cut AS (SELECT row_number() OVER () AS r, doc_id, text, {words_sql("text")} FROM (SELECT doc_id, coalesce(text, '') AS text FROM docs)),
pieces AS (SELECT r, unnest(range(len(w))) AS place, unnest(w) AS word, unnest(g) AS gap FROM cut),
alone AS (SELECT *, {tag_sql("lower(word)")} AS own, {kind_sql("word")} IS NOT NULL AS known FROM pieces),
placed AS (SELECT *, CASE WHEN ({matches("word", wd.CAPITAL)} AND own NOT IN ({", ".join(map(repr, wd.CLOSED))}) AND (known OR (place > 0 AND NOT {matches("gap", wd.SENTENCE)} AND own <> 'Y'))) OR {among("word", wd.ALL_TITLES)} THEN 'P' ELSE own END AS tag FROM alone),
strings AS (SELECT r, string_agg(CASE WHEN NOT {matches("gap", wd.SIGN)} THEN ' ' WHEN gap = '-' THEN '-' ELSE '|' END || tag, '' ORDER BY place) AS tags FROM placed GROUP BY 1),
owners AS (SELECT r, place, CASE lower(word) WHEN 'her' THEN {possessive_sql("(place + 1)")} ELSE {matches("tags[place * 2 + 3:]", swap.AFTER_HIS)} END AS owner FROM placed JOIN strings USING (r) JOIN cut USING (r) WHERE {among("lower(word)", (*POSSESSIVE, "her"))}),
joined AS (SELECT r, count(*) AS n, sum(length(gap) + length(word))::BIGINT AS size, string_agg({signs_sql("gap")} || word || ':' || CASE WHEN owner THEN 'O' ELSE tag END, ' ' ORDER BY place) AS tokens, string_agg(own, '' ORDER BY place) AS owns FROM placed LEFT JOIN owners USING (r, place) GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, trim(coalesce(tokens, '') || ' ' || {signs_sql("substr(text, 1 + coalesce(size, 0))")}, ' ') AS tagged, coalesce(owns, '') AS own_tags FROM cut LEFT JOIN joined USING (r)""")
def tagged_tokens(spark, sf_dir):
    """All words and signs of every document in order, each with its tag in its place, and the words' tags by themselves.

    Besides tags of words, X is a sign and O a pronoun before what is someone's.
    """
    signs = lambda c: F.regexp_replace(F.regexp_replace(c, r"[\x09-\x0D\x20]+", ""), f"({wd.SIGN})", "$1:X ")
    rows = _documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    rows = wd.held(rows, w=wd.words(F.col("text")), g=wd.gaps(F.col("text")))
    names = wd.by_gender(None)
    rows = wd.held(rows, t=F.transform("w", lambda word, i: swap.tags(word, F.get("g", i), i, names)), size=F.aggregate(F.zip_with("g", "w", lambda a, b: F.length(a) + F.length(b)), F.lit(0), lambda a, n: a + n))
    rows = wd.held(rows, s=F.array_join(F.zip_with("g", "t", lambda gap, t: F.concat(swap.between(gap), t["tag"])), ""))

    def one(word, i):
        owner = F.when(F.lower(word) == "her", swap.her_is_possessive(F.col("w"), F.col("g"), F.col("s"), i)).when(F.lower(word).isin(*POSSESSIVE), swap.rest(F.col("s"), i).rlike(swap.AFTER_HIS))
        return F.concat(signs(F.get("g", i)), word, F.lit(":"), F.when(owner, "O").otherwise(F.get("t", i)["tag"]))

    tagged = F.trim(F.concat(F.array_join(F.transform("w", one), " "), F.lit(" "), signs(F.substring("text", F.col("size") + 1, F.length("text")))))
    return rows.select("doc_id", F.size("w").cast("long").alias("n_words"), tagged.alias("tagged"), F.array_join(F.transform("t", lambda t: t["own"]), "").alias("own_tags"))


@query(rf"""{_DOCS}, said AS (SELECT doc_id, array_to_string(regexp_extract_all(text, {quote(wd.QUOTE)}), ' ') AS q FROM docs)
SELECT doc_id, len(w) AS n_quoted, array_to_string(w, ' ') AS quoted FROM (SELECT doc_id, regexp_extract_all(q, {quote(wd.PIECE)}, 2) AS w FROM said) WHERE len(w) > 0""")
def quoted_tokens(spark, sf_dir):
    """The words in quotes of every document that has any."""
    rows = wd.token_table(_documents(spark, sf_dir), ["doc_id"]).filter("quoted")
    listed = F.array_sort(F.collect_list(F.struct("place", "word")))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_quoted"), F.array_join(F.transform(listed, lambda x: x["word"]), " ").alias("quoted"))


def _name_parts(spark, sf_dir):
    return wd.name_parts(wd.token_table(_documents(spark, sf_dir), ["doc_id"]), ["doc_id"], lexicon.names_table(spark))


@query(rf"{_DOCS}{people_sql('docs', 'doc_id', 'text', 'd')} SELECT doc_id, run, regexp_replace(marked[3:], '\x02.', ' ', 'g') AS span FROM d_runs")
def name_runs(spark, sf_dir):
    """The maximal runs of name parts of every document."""
    return wd.span_table(_name_parts(spark, sf_dir), ["doc_id"]).select("doc_id", "run", "span")


@query(f"{_DOCS}{people_sql('docs', 'doc_id', 'text', 'd')} SELECT doc_id, name, gender FROM d_names")
def found_names(spark, sf_dir):
    """The people every document names, with their genders."""
    return wd.people_table(wd.span_table(_name_parts(spark, sf_dir), ["doc_id"]), ["doc_id"]).select("doc_id", "name", "gender")


@query(f"""/* documents */ WITH docs AS (SELECT doc_id, ['Mr. ', 'Mrs. ', 'Dr. ', 'Miss '][1 + doc_id % 4] || text AS text FROM documents){people_sql('docs', 'doc_id', 'text', 'd')} SELECT doc_id, name, gender FROM d_names WHERE titled""")
def titled_surnames(spark, sf_dir):
    """Surnames after a gendered title, with its gender, in documents with a title put before them."""
    titles = F.get(F.array(*map(F.lit, ("Mr. ", "Mrs. ", "Dr. ", "Miss "))), (F.col("doc_id") % 4).cast("int"))
    rows = _documents(spark, sf_dir).withColumn("text", F.concat(titles, "text"))
    parts = wd.name_parts(wd.token_table(rows, ["doc_id"]), ["doc_id"], lexicon.names_table(spark))
    return wd.people_table(wd.span_table(parts, ["doc_id"]), ["doc_id"]).filter("titled").select("doc_id", "name", "gender")


# --- name-level reasons -----------------------------------------------------------------


@query(lambda: data.cte() + final_sql() + "SELECT model_tag, coalesce(reason, 'usable') AS reason, count(*) AS n FROM final GROUP BY 1, 2")
def name_level_reasons(spark, sf_dir):
    return fn.reasons_by_model(fn.labelled(data.completions(spark, sf_dir)))


@query(lambda: data.cte() + final_sql("model_tag = 'base'") + "SELECT occupation, template_id, sample_id, reason, gender, name, name_gender FROM final")
def name_reasons(spark, sf_dir):
    rows = fn.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'").drop("name"))
    return rows.select(*KEY[1:], "reason", "gender", "name", "name_gender")


# --- pronouns and swaps -----------------------------------------------------------------


def cased_sql(word: str, to: str) -> str:
    return f"CASE WHEN upper({word}) = {word} AND lower({word}) <> {word} AND length({word}) > 1 THEN upper({to}) WHEN upper({word}[1]) = {word}[1] AND lower({word}[1]) <> {word}[1] THEN upper({to}[1]) || {to}[2:] ELSE {to} END"


def words_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {quote(wd.PIECE)}, 2) AS w, regexp_extract_all({text}, {quote(wd.PIECE)}, 1) AS g"


def tags_sql() -> str:
    """The tag string of w and g."""
    proper = f"{matches('w[i]', wd.CAPITAL)} AND tag NOT IN ({', '.join(map(repr, wd.CLOSED))}) AND i > 1 AND NOT {matches('g[i]', wd.SENTENCE)} AND tag <> 'Y'"
    own = f"(CASE WHEN ({proper.replace('tag', '(' + tag_sql('lower(w[i])') + ')')}) OR {among('w[i]', wd.ALL_TITLES)} THEN 'P' ELSE {tag_sql('lower(w[i])')} END)"
    between = f"CASE WHEN NOT {matches('g[i]', wd.SIGN)} THEN ' ' WHEN g[i] = '-' THEN '-' ELSE '|' END"
    return f"array_to_string(list_transform(range(1, len(w) + 1), lambda i: ({between}) || {own}), '')"


def possessive_sql(i: str = "i") -> str:
    return f"(coalesce(lower(w[{i} + 1]) = 'to' AND g[{i} + 2] = '-' AND lower(w[{i} + 2]) = 'do', false) OR {matches(f'tags[{i} * 2 + 1:]', swap.NOUN_AFTER_HER)})"


@query(lambda: data.cte() + f""" SELECT occupation, template_id, sample_id, len(list_filter(range(1, len(w) + 1), lambda i: lower(w[i]) = 'her')) AS n_her, len(list_filter(range(1, len(w) + 1), lambda i: lower(w[i]) = 'her' AND {possessive_sql()})) AS n_possessive
FROM (SELECT *, {tags_sql()} AS tags FROM (SELECT occupation, template_id, sample_id, {words_sql("completion")} FROM completions WHERE model_tag = 'base') WHERE list_contains(list_transform(w, lambda x: lower(x)), 'her'))""")
def possessive_her(spark, sf_dir):
    """Of every completion with the word, how often it stands before what is hers."""
    rows = data.completions(spark, sf_dir).filter("model_tag = 'base'").select(*KEY[1:], "completion")
    rows = wd.held(rows, w=wd.words(F.col("completion")), g=wd.gaps(F.col("completion")))
    rows = wd.held(rows.filter(F.exists("w", lambda x: F.lower(x) == "her")), tags=swap.tag_string(F.col("w"), F.col("g")))
    rows = wd.held(rows, at=F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.lower(F.get("w", i)) == "her"))
    own = F.filter("at", lambda i: swap.her_is_possessive(F.col("w"), F.col("g"), F.col("tags"), i))
    return rows.select(*KEY[1:], F.size("at").cast("long").alias("n_her"), F.size(own).cast("long").alias("n_possessive"))


@query(lambda: f"""/* conversations */ SELECT conv_id, turn, source, {cased_sql('source', 'role')} AS cased FROM (SELECT conv_id, turn, role, regexp_extract(text, {quote(wd.WORD)}) AS source FROM conversations WHERE {matches('text', wd.WORD)})""")
def matched_case(spark, sf_dir):
    """The role in the case of each turn's first word."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").filter(F.col("text").rlike(wd.WORD))
    rows = rows.select("conv_id", "turn", "role", F.regexp_extract("text", wd.WORD, 0).alias("source"))
    return rows.select("conv_id", "turn", "source", tx.match_case(F.col("source"), F.col("role")).alias("cased"))


def _swap_sql() -> str:
    """WITH clauses up to <swapped>: every source text with its outcome, swapped text and failure.

    Middle names aren't stated: texts of the given tables have none between a protagonist's names.
    """
    key = "occupation, template_id, sample_id"
    fixed = lambda to: "CASE lower(w[i]) " + " ".join(f"WHEN {quote(a)} THEN {cased_sql('w[i]', quote(b))}" for a, b in swap.FIXED[to].items()) + " END"
    titles = " ".join(f"WHEN target_gender = '{to}' AND w[i] = '{a}{dot}' AND list_contains(own, w[i + 1]) THEN '{b}{dot}'" for to, ts in lx.TITLE_TO.items() for a, b in ts.items() for dot in ("", "."))
    count = lambda t, g: data.sql_count(t, tx.PRONOUNS[g])
    wrong = lambda g: "[" + ", ".join(map(quote, wd.TITLES[g])) + "]"
    nouns = data.sql_words("(?i:" + "|".join(sorted(lx.PERSON_NOUNS)) + ")")
    ours = _CALIBRATION.replace("FROM labelled", "FROM final")
    pool = f""", names(name, gender) AS (VALUES {data.values(sorted(lexicon.default_names().items()))}), pool AS (SELECT names.gender, name, count(*) AS n FROM final JOIN names USING (name) WHERE usable AND names.gender <> 'unisex' AND name NOT IN ({', '.join(repr(n) for n in sorted(lexicon.SURNAMES))}) GROUP BY 1, 2),
every AS (SELECT gender AS target_gender, list(name ORDER BY n DESC, name) FILTER (n >= {pairs.LEAST_NAME_COUNT}) AS frequent, list(name ORDER BY n DESC, name) AS every FROM pool GROUP BY 1)"""
    return f"""{final_sql("model_tag = 'base'")}{ours}{pool},
options AS (SELECT s.*, CASE WHEN len(list_filter(frequent, lambda x: x IS DISTINCT FROM s.name)) > 0 THEN list_filter(frequent, lambda x: x IS DISTINCT FROM s.name) ELSE list_filter(every, lambda x: x IS DISTINCT FROM s.name) END AS names_ FROM sources s LEFT JOIN every USING (target_gender)),
picked AS (SELECT *, CASE WHEN outcome = 'candidate' AND len(names_) > 0 THEN names_[1 + {data.sql_draw(f"'{SEED}'", "'name'", "occupation", "template_id::VARCHAR", "sample_id::VARCHAR")} % len(names_)] END AS picked_name FROM options),
lasts AS (SELECT {key}, list(DISTINCT last) FILTER (last IS NOT NULL) AS lasts FROM t_people GROUP BY ALL),
asked AS (SELECT p.*, lasts, CASE WHEN NOT (name_gender = 'unisex' OR titled OR name NOT IN (SELECT name FROM names)) THEN name END AS old, list_concat([name], coalesce(lasts, [])) AS own FROM picked p LEFT JOIN lasts USING ({key}) WHERE picked_name IS NOT NULL),
cut AS (SELECT *, {words_sql("completion")} FROM asked),
tagged AS (SELECT *, {tags_sql()} AS tags FROM cut),
edited AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i] = old THEN picked_name {titles}
    WHEN target_gender = 'female' AND {among("lower(w[i])", swap.FIXED["female"])} THEN {fixed("female")} WHEN target_gender = 'male' AND {among("lower(w[i])", swap.FIXED["male"])} THEN {fixed("male")}
    WHEN target_gender = 'female' AND lower(w[i]) = 'his' THEN CASE WHEN {matches("tags[i * 2 + 1:]", swap.AFTER_HIS)} THEN {cased_sql("w[i]", "'her'")} ELSE {cased_sql("w[i]", "'hers'")} END
    WHEN target_gender = 'male' AND lower(w[i]) = 'her' THEN CASE WHEN {possessive_sql()} THEN {cased_sql("w[i]", "'his'")} ELSE {cased_sql("w[i]", "'him'")} END ELSE w[i] END) AS edits FROM tagged),
made AS (SELECT *, array_to_string(list_transform(range(1, len(w) + 1), lambda i: g[i] || edits[i]), '') || substr(completion, 1 + length(array_to_string(list_transform(range(1, len(w) + 1), lambda i: g[i] || w[i]), ''))) AS swapped FROM edited)
{people_sql("made", key, "swapped", "a")}, left_names AS (SELECT {key}, list(name) AS later, list(gender) FILTER (gender IS NOT NULL) AS genders, count(*) FILTER (gender IS NULL) AS n_unsure FROM a_people GROUP BY ALL),
checked AS (SELECT *, regexp_extract_all(swapped, {quote(wd.PIECE)}, 2) AS after_words, CASE target_gender WHEN 'male' THEN {count("swapped", "female")} ELSE {count("swapped", "male")} END AS n_other, CASE target_gender WHEN 'male' THEN {count("swapped", "male")} ELSE {count("swapped", "female")} END AS n_target,
    {count("completion", "male")} + {count("completion", "female")} AS n_before FROM made LEFT JOIN left_names USING ({key})),
judged AS (SELECT *, CASE WHEN name IS NULL THEN 'not_single_name' WHEN name_gender IS NULL THEN 'unknown_name' WHEN {matches("completion", nouns)} THEN 'person_noun'
    WHEN target_gender = 'male' AND len(list_filter(range(2, len(w) + 1), lambda i: lower(w[i]) = 'her' AND {among("lower(w[i - 1])", swap.two_object_forms())} AND NOT {matches("g[i]", wd.SIGN)} AND {possessive_sql()})) > 0 THEN 'ambiguous_her'
    WHEN n_other > 0 OR n_target <> n_before THEN 'pronoun_check_failed' WHEN list_contains(later, old) THEN 'name_not_replaced'
    WHEN n_unsure > 0 OR len(list_filter(genders, lambda x: x NOT IN ('unisex', target_gender))) > 0 THEN 'name_check_failed'
    WHEN len(list_filter(range(1, len(after_words) + 1), lambda i: list_contains(CASE target_gender WHEN 'female' THEN {wrong("m")} ELSE {wrong("f")} END, after_words[i]) AND coalesce(list_contains(list_append(own, picked_name), after_words[i + 1]), false))) > 0 THEN 'title_check_failed' END AS fail FROM checked),
built AS (SELECT s.occ_ordinal, s.occupation, s.template_id, s.sample_id, s.gender AS rejected_gender, s.target_gender AS chosen_gender, s.name AS old_name, s.completion AS rejected, s.other_person_flag, j.swapped, j.fail, s.picked_name, j.old,
    CASE WHEN s.outcome <> 'candidate' THEN s.outcome WHEN j.swapped IS NOT NULL AND j.fail IS NULL THEN 'paired' ELSE 'swap_failed' END AS outcome, CASE WHEN s.outcome = 'candidate' AND s.picked_name IS NULL THEN 'no_replacement_name' ELSE j.fail END AS swap_failure
  FROM picked s LEFT JOIN judged j USING ({key}))
"""


def _built(spark, sf_dir):
    labelled = files.work_table(fn.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'").drop("name")), "labelled")  # read three times
    return files.work_table(pairs.build(spark, labelled, lexicon.names_table(spark), pairs.calibration(spark, labelled)), "built")


@query(lambda: data.cte() + _swap_sql() + """SELECT row_number() OVER (ORDER BY occ_ordinal, template_id, sample_id) - 1 AS pair_id, occupation, template_id, sample_id, rejected_gender, chosen_gender, old_name, CASE WHEN old IS NULL THEN old_name ELSE picked_name END AS new_name, rejected, swapped AS chosen, other_person_flag FROM built WHERE outcome = 'paired'""")
def swap_pairs(spark, sf_dir):
    return pairs.numbered(_built(spark, sf_dir)).select("pair_id", "occupation", "template_id", "sample_id", "rejected_gender", "chosen_gender", "old_name", "new_name", "rejected", "chosen", "other_person_flag")


@query(lambda: data.cte() + _swap_sql() + """SELECT metric, key, count(*) AS n FROM (SELECT 'outcome' AS metric, outcome AS key FROM built UNION ALL SELECT 'swap_failure', swap_failure FROM built UNION ALL SELECT 'direction', rejected_gender || '->' || chosen_gender FROM built WHERE outcome = 'paired' UNION ALL SELECT 'occupation', occupation FROM built WHERE outcome = 'paired') WHERE key IS NOT NULL GROUP BY 1, 2""")
def pair_statistics(spark, sf_dir):
    return pairs.statistics(_built(spark, sf_dir))


@query(lambda: data.cte() + _swap_sql() + "SELECT count(*) FILTER (outcome = 'paired') AS n_pairs, count(*) FILTER (outcome = 'paired') < 200 AS alarm FROM built")
def pair_count_alarm(spark, sf_dir):
    """Over pairs that are built."""
    return pairs.alarms(_built(spark, sf_dir))


@query(lambda: data.cte() + _swap_sql() + f"SELECT occupation, template_id, sample_id, target_gender AS target, picked_name AS new_name, CASE WHEN fail IS NULL THEN {data.sql_draw("'x'", 'swapped')} END AS swapped, fail FROM judged")
def swap_outcomes(spark, sf_dir):
    """What becomes of each candidate: a draw of its swapped text, or the failure's code."""
    labelled = files.work_table(fn.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'").drop("name")), "labelled")
    rows = pairs.candidates(spark, labelled, lexicon.names_table(spark), pairs.calibration(spark, labelled)).filter("picked is not null")
    rows = swap.swapped(rows, F.col("completion"), F.col("target_gender"), F.col("picked"))
    return rows.select(*KEY[1:], F.col("target_gender").alias("target"), F.col("picked").alias("new_name"), F.when(F.col("swap.text").isNotNull(), draw("x", F.col("swap.text"))).alias("swapped"), F.col("swap.fail").alias("fail"))


# --- the same from SQL text -------------------------------------------------------------


@query(f"{_DOCS}{people_sql('docs', 'doc_id', 'text', 'd')} SELECT doc_id, name, gender, titled FROM d_names")
def sql_names(spark, sf_dir):
    """The people every document names, asked for in SQL."""
    sqltext.register(spark)
    return spark.sql("SELECT d.doc_id, p.name, p.gender, p.titled FROM {docs} d, LATERAL names_of(d.text) p", docs=_documents(spark, sf_dir))


@query(lambda: data.cte() + final_sql() + "SELECT model_tag, reason, gender, name_gender, count(*) AS n, count(DISTINCT name) AS n_names FROM final GROUP BY 1, 2, 3, 4")
def sql_annotations(spark, sf_dir):
    """All completions annotated in SQL, and counted."""
    sqltext.register(spark)
    return spark.sql(
        """SELECT model_tag, a.reason, a.gender, a.name_gender, count(*) AS n, count(DISTINCT a.name) AS n_names
        FROM (SELECT model_tag, annotate_text(completion, truncated) AS a FROM {texts}) GROUP BY ALL""",
        texts=data.completions(spark, sf_dir),
    )


@query(lambda: oracle_sql_of("swap_outcomes"))
def sql_swaps(spark, sf_dir):
    """What becomes of each candidate, by the swap in SQL."""
    sqltext.register(spark)
    labelled = files.work_table(fn.labelled(data.completions(spark, sf_dir).filter("model_tag = 'base'").drop("name")), "labelled")
    rows = pairs.candidates(spark, labelled, lexicon.names_table(spark), pairs.calibration(spark, labelled)).filter("picked is not null")
    made = spark.sql("SELECT *, swap_gender(completion, target_gender, picked) AS made FROM {rows}", rows=rows)
    swapped = F.when(F.col("made.text").isNotNull(), draw("x", F.col("made.text")))
    return made.select(*KEY[1:], F.col("target_gender").alias("target"), F.col("picked").alias("new_name"), swapped.alias("swapped"), F.col("made.fail").alias("fail"))
