"""The registered queries as SQL over the given tables, for checking the results."""

from __future__ import annotations

from moodmill.operators.language import TOP_GRAMS
from moodmill.operators.splits import SEED
from moodmill.plans.queries import BATCH, CLASSES, DIM, FREQUENT, GIVEN, HEADS, MAX_LEN, WIDE
from moodmill.plans.relations import EMOJIS, LABEL_MAP, TAILS

# The classes of characters, written for the other regex dialect.
PUNCTUATION = r"!-/:-@\[-`{-~"
SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _regex(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


def trim_string(x: str) -> str:
    return f"trim({_regex(x, f'[{SPACES}]+', ' ')})"


def b1(x: str) -> str:
    return _regex(x, r"[\x00-\x1f\x7f-\x{9f}]", "")


def b2(x: str) -> str:
    return _regex(_regex(x, f"http[^{SPACES}]+", ""), f"^[{SPACES}]+|[{SPACES}]+$", "")


def b3(x: str) -> str:
    y = f"replace(replace({x}, chr(10), ' '), 'RT ', '')"
    for entity in ("&amp;", "&lt;", "&br;", "&gt;"):
        y = f"replace({y}, '{entity}', ' ')"
    words = f"string_split({trim_string(y)}, ' ')"
    return f"array_to_string(list_filter({words}, lambda w: NOT (starts_with(w, '@') OR starts_with(w, '#'))), ' ')"


def b4(x: str) -> str:
    return trim_string(_regex(x, f"[{PUNCTUATION}]", " "))


def b5(x: str, keep: int) -> str:
    return trim_string(_regex(x, f"([{PUNCTUATION}]{{1,{keep}}})[{PUNCTUATION}]*", r" \1 "))


def b7(x: str) -> str:
    return _regex(x, r"[^ -\[\]-~а-яА-ЯёЁ\t\n\x0b\f\r]", " ")


def b8(x: str) -> str:
    return f"replace(replace({trim_string(b7(x))}, '. ', ''), ', ', '')"


def b9(x: str) -> str:
    return b4(f"lower({x})")


def b10(x: str) -> str:
    return b4(b3(b2(b1(x))))


def b13(x: str) -> str:
    for emoji in sorted(e for e, is_64 in EMOJIS if is_64):
        x = f"replace({x}, '{emoji}', '')"
    return x


def occurrences(text: str, part: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, {part}, ''))) // length({part}) AS BIGINT)"


def rounded(x: str) -> str:
    """A rounded mean; the shift keeps exact decimal ties from falling to either side."""
    return f"round({x} + 1e-9, 5)"


def digest(x: str) -> str:
    return f"md5(array_to_string({x}, '|'))"


def numbers(values: list[float]) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def vector_columns(v: str, dim: int = DIM) -> str:
    ramp = numbers([i + 1 for i in range(dim)])
    return (
        f"round({v}[1], 5) + 0.0 AS v_first, round({v}[{dim}], 5) + 0.0 AS v_last, "
        f"round(list_sum({v}), 5) + 0.0 AS v_sum, round(list_dot_product({v}, {ramp}), 4) + 0.0 AS v_weighted"
    )


# Relations, each with those it needs.
LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""
_TAILS = "[" + ", ".join(f"'{t}'" for t in TAILS) + "]"
TWEETS = LINES + f""", tweets AS (
  SELECT doc_id, pos, lang, source AS source_file, concat(
    CASE WHEN length(line) % 5 = 0 THEN concat('RT @u', doc_id, ': ') ELSE '' END, line,
    CASE WHEN length(line) % 4 = 0 THEN ' http://t.co/x1 #tag' ELSE '' END,
    CASE WHEN length(line) % 6 = 0 THEN ' a &amp; b' ELSE ' ' END,
    ({_TAILS})[length(line) % {len(TAILS)} + 1]) AS text FROM lines)"""
JUNK = "(contains(text, '$$$') OR contains(text, '%%%') OR contains(text, '&&&'))"
CLEANED = TWEETS + f""", cleaned AS MATERIALIZED (
  SELECT doc_id, pos, lang, source_file, {b10('text')} AS text FROM tweets)"""
DICTIONARY = "dict(emoji, is_64) AS (VALUES " + ", ".join(f"('{e}', {str(s).lower()})" for e, s in EMOJIS) + ")"


def verdicts(min_len: int, one_type: bool, no_other: bool, one_block: bool) -> str:
    """Labels and refusals of ``cleaned``."""
    block = f"len(regexp_extract_all(replace(text, class, '⁂'), '⁂+')) > 1"
    return CLEANED + ", " + DICTIONARY + f""", hits AS (
  SELECT doc_id, pos, emoji, is_64, {occurrences('text', 'emoji')} AS n
  FROM cleaned JOIN dict ON contains(text, emoji)), sums AS (
  SELECT doc_id, pos, count(*) FILTER (is_64) AS kinds, count(*) FILTER (NOT is_64) AS others,
         min(struct_pack(n := -n, emoji := emoji)) FILTER (is_64) AS top FROM hits GROUP BY ALL), verdicts AS (
  SELECT doc_id, pos, lang, source_file, text, class, count,
    CASE WHEN coalesce(kinds, 0) = 0 THEN 'no_emoji'
         WHEN {str(no_other).lower()} AND others > 0 THEN 'other_emoji'
         WHEN {str(one_type).lower()} AND kinds > 1 THEN 'several_types'
         WHEN len(string_split(rest, ' ')) < {min_len} AND length(rest) < {min_len} THEN 'too_short'
         WHEN {str(one_block).lower()} AND {block} THEN 'several_blocks'
         ELSE 'kept' END AS verdict
  FROM (SELECT c.*, kinds, others, top.emoji AS class, -top.n AS count, {b13('text')} AS rest
        FROM cleaned c LEFT JOIN sums USING (doc_id, pos)))"""


VERDICTS = verdicts(5, True, True, False)
LABELLED = VERDICTS + """, labelled AS (
  SELECT DISTINCT source_file, text, class, count FROM verdicts WHERE verdict = 'kept')"""


def grams(name: str, source: str, key: str, text: str) -> str:
    """Character 1- to 3-grams of a relation: ``key, gram``, repeats kept."""
    return f"""{name}_chars AS (
  SELECT {key}, unnest(string_split({text}, '')) AS c, generate_subscripts(string_split({text}, ''), 1) AS i
  FROM {source} WHERE length({text}) > 0), {name}_runs AS (
  SELECT {key}, c, lead(c) OVER w AS d, lead(c, 2) OVER w AS e FROM {name}_chars
  WINDOW w AS (PARTITION BY {key} ORDER BY i)), {name} AS (
  SELECT {key}, c AS gram FROM {name}_runs
  UNION ALL SELECT {key}, c || d FROM {name}_runs WHERE d IS NOT NULL
  UNION ALL SELECT {key}, c || d || e FROM {name}_runs WHERE e IS NOT NULL)"""


PROFILES = grams("doc_grams", "documents", "doc_id", "text") + f""", gram_counts AS MATERIALIZED (
  SELECT lang, gram, count(*) AS n FROM doc_grams JOIN documents USING (doc_id) GROUP BY ALL), profiles AS (
  SELECT lang, gram, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rank
  FROM gram_counts QUALIFY rank <= {TOP_GRAMS})"""
BAYES = PROFILES + """, vocab AS MATERIALIZED (SELECT DISTINCT gram FROM gram_counts), totals AS (
  SELECT lang, sum(n) AS total FROM gram_counts JOIN vocab USING (gram) GROUP BY lang), priors AS (
  SELECT lang, ln((count(*) + 1) / ((SELECT count(*) FROM documents)
    + (SELECT count(DISTINCT lang) FROM documents))) AS prior FROM documents GROUP BY lang), theta AS MATERIALIZED (
  SELECT t.lang, v.gram, ln((coalesce(g.n, 0) + 1) / (t.total + (SELECT count(*) FROM vocab))) AS w
  FROM totals t CROSS JOIN vocab v LEFT JOIN gram_counts g ON g.lang = t.lang AND g.gram = v.gram)"""


def languages(source: str, key: str, text: str) -> str:
    """``answers(key, lang, prob)`` for a relation."""
    return grams("asked", source, key, text) + f""", scored AS (
  SELECT {key}, lang, sum(n * w) AS s FROM (SELECT {key}, gram, count(*) AS n FROM asked GROUP BY ALL)
  JOIN theta USING (gram) GROUP BY ALL), full_scores AS (
  SELECT k.*, p.lang, p.prior + coalesce(s.s, 0) AS s
  FROM (SELECT DISTINCT {key} FROM asked JOIN vocab USING (gram)) k CROSS JOIN priors p LEFT JOIN scored s USING ({key}, lang)), tops AS (
  SELECT {key}, max(s) AS top FROM full_scores GROUP BY ALL), answers AS (
  SELECT {key}, arg_min(lang, struct_pack(s := -s, lang := lang)) AS lang, 1 / sum(exp(s - top)) AS prob
  FROM full_scores JOIN tops USING ({key}) GROUP BY ALL)"""


WORDS = """words AS (
  SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS word FROM documents)"""
RANKED = WORDS + """, ranked AS (
  SELECT word AS token, count(*) AS n FROM words WHERE word NOT IN (' ', 'UNK') GROUP BY word), vocabulary AS MATERIALIZED (
  SELECT ' ' AS token, 0 AS idx, 0 AS n UNION ALL SELECT 'UNK', 1, 0
  UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1, n FROM ranked)"""
TOKENS = RANKED + """, tokens AS MATERIALIZED (
  SELECT token, idx, embedding::DOUBLE[] AS vector FROM vocabulary JOIN embeddings ON vec_id = idx)"""


def word_grams(word: str, low: int, high: int = 6) -> str:
    """The n-grams of a marked word as a list."""
    marked = f"('<' || {word} || '>')"
    parts = [
        f"list_transform(range(1, length({word}) + {4 - n}), lambda i: substring({marked}, i, {n}))"
        for n in range(low, high + 1)
    ]
    bare = f"CASE WHEN length({word}) < 3 THEN [{word}] ELSE [] END"
    return "flatten([" + ", ".join(parts) + f", {bare}])"


GRAMS = TOKENS + f""", grammed AS (SELECT word, {word_grams('word', 1)} AS g FROM (SELECT DISTINCT word FROM words)),
  word_hits AS MATERIALIZED (
  SELECT word, i, idx, vector FROM (
    SELECT word, unnest(g) AS token, generate_subscripts(g, 1) AS i FROM grammed) JOIN tokens USING (token)),
  unk AS (SELECT idx, vector FROM tokens WHERE token = 'UNK')"""


def mean_vector(weight: str, group: str, source: str, vector: str = "vector") -> str:
    """Weighted mean of vectors per group, dimension by dimension."""
    return f"""SELECT {group}, list(x ORDER BY d) AS vector FROM (
    SELECT {group}, d, sum(x * wt) / sum(wt) AS x FROM (
      SELECT {group}, unnest({vector}) AS x, generate_subscripts({vector}, 1) AS d, {weight} AS wt FROM {source})
    GROUP BY ALL) GROUP BY ALL"""


def _dot(head: int, vector: str = "vector") -> str:
    return f"list_dot_product({vector}, {numbers(HEADS[head])})"


def word_vectors(weight: str) -> str:
    return GRAMS + f""", known AS ({mean_vector(weight, 'word', 'word_hits')}), word_vectors AS MATERIALIZED (
  SELECT word, coalesce(k.vector, (SELECT vector FROM unk)) AS vector
  FROM (SELECT DISTINCT word FROM words) LEFT JOIN known k USING (word))"""


STEPS = TOKENS + f""", talk AS (
  SELECT conv_id, turn, role, string_split(replace(text, chr(10), ' '), ' ') AS t FROM conversations), padded AS (
  SELECT conv_id, turn, role, least(len(t), {MAX_LEN}) AS seq_len, unnest(range(0, {MAX_LEN})) AS pos, t FROM talk),
  steps AS MATERIALIZED (
  SELECT conv_id, turn, role, seq_len, pos, v.vector FROM (
    SELECT p.*, CASE WHEN pos < len(t) THEN coalesce(k.idx, 1) ELSE 0 END AS idx
    FROM padded p LEFT JOIN tokens k ON k.token = p.t[pos + 1]) JOIN tokens v USING (idx))"""
WIDE_STEPS = STEPS.replace("pos, v.vector", f"pos, flatten([{', '.join(['v.vector'] * WIDE)}]) AS vector", 1)
METRICS = """metrics AS (
  SELECT user_id AS run, dayofyear(ts) AS epoch, event_id AS batch, value,
    CASE WHEN event_type IN ('click', 'view') THEN 'Train' ELSE 'Val' END AS loop,
    CAST(props->>'$.k' AS BIGINT) + 1 AS n FROM events)"""
KEY = f"md5('{SEED}|' || {{}})"


def pooled(weight: str, where: str = "true") -> str:
    return f"pooled AS ({mean_vector(weight, 'conv_id, turn', f'(SELECT * FROM steps WHERE {where})')})"


def _with(relations: str, select: str) -> str:
    return f"WITH {relations} {select}"


def _cleaned(table: str, key: str, x: str, out: str = "cleaned") -> str:
    if table == "tweets":
        return _with(TWEETS, f"SELECT {key}, {x} AS {out} FROM tweets")
    return f"SELECT {key}, {x} AS {out} FROM {table}"


def _split(table: str, key: str, share: float) -> str:
    return f"""SELECT *, row_number() OVER (ORDER BY {KEY.format(key)}) <= ceil({share} * count(*) OVER ()) AS is_val
  FROM {table}"""


def _sides(value: str) -> str:
    return ", ".join(
        rounded(f"sum({v} * n) FILTER (loop = '{loop}') / sum(n) FILTER (loop = '{loop}')") + f" AS {loop.lower()}_{m}"
        for loop in ("Train", "Val")
        for m, v in (("loss", "value"), ("top1", "n"), ("top3", "least(n * 1.5, 100.0)"))
    )


def _bodies() -> dict[str, str]:
    two = "doc_id, pos"
    by_turn = "conv_id, turn"
    sql = {
        "a1_read_tweets": _with(
            TWEETS, f"SELECT source_file, text FROM tweets WHERE NOT {JUNK}"
        ),
        "a2_split_bad_records": _with(TWEETS, """SELECT source_file,
  CASE WHEN contains(text, '%%%') THEN '{"text": null}' ELSE '{"text": "' || doc_id END AS raw,
  CASE WHEN contains(text, '%%%') THEN 'null_text' ELSE 'invalid_json' END AS reason
  FROM tweets WHERE NOT contains(text, '$$$') AND (contains(text, '%%%') OR contains(text, '&&&'))"""),
        "a3_read_emoji_dictionary": """SELECT emoji, description, is_64 FROM (
  SELECT source || '/' || lang AS emoji, bool_or(contains(text, '!!') OR doc_id = 64) AS is_64,
    'entry of ' || arg_max(doc_id || CASE WHEN contains(text, '!!') THEN ' 64' ELSE '' END, doc_id) AS description
  FROM documents
  WHERE NOT (contains(text, '$$$') OR contains(text, '%%%') OR contains(text, '&&&')) GROUP BY source, lang)""",
        "a4_write_prepared": _with(
            TWEETS + ", " + DICTIONARY + f""", labels AS (
  SELECT doc_id, pos, min(struct_pack(n := -{occurrences('text', 'emoji')}, emoji := emoji)) AS top
  FROM tweets JOIN dict ON contains(text, emoji) WHERE is_64 GROUP BY ALL)""",
            "SELECT doc_id, pos, lang, top.emoji AS class, -top.n AS count FROM labels JOIN tweets USING (doc_id, pos)",
        ),
        "a6_read_training": "SELECT text, n_chars FROM documents WHERE lang = 'en'",
        "a7_read_lines": _with(LINES, "SELECT line FROM lines"),
        "a7_read_lines_first": _with(LINES, "SELECT line FROM lines ORDER BY doc_id, pos LIMIT 500"),
        "a8_bucketed_token_table": _with(TOKENS, """SELECT word AS token, idx, count(*) AS n
  FROM words LEFT JOIN tokens ON word = token GROUP BY word, idx"""),
        "a8_bucketed_id_table": _with(TOKENS, f"""SELECT vec_id, label AS idx, token, {vector_columns('vector')}
  FROM embeddings LEFT JOIN tokens ON label = idx"""),
        "a8_read_token_table": _with(TOKENS, f"SELECT token, idx, {vector_columns('vector')} FROM tokens"),
        "b1_remove_control_chars": _cleaned("documents", "doc_id", b1("text")),
        "b2_remove_links": _cleaned("tweets", two, b2("text")),
        "b2_remove_links_url": _cleaned("pages", "page_id", b2("url")),
        "b3_remove_tags": _cleaned("tweets", two, b3("text")),
        "b4_space_punctuation": _cleaned("documents", "doc_id", b4("text")),
        "b5_space_punctuation_keep": _cleaned("pages", "page_id", b5("html", 4)),
        "b5_space_punctuation_keep_tweets": _cleaned("tweets", two, b5("text", 2)),
        "b6_trim_string": _cleaned("documents", "doc_id", trim_string("text")),
        "b7_remove_non_printed_chars": _cleaned("pages", "page_id", b7("html")),
        "b8_process_text": _cleaned("pages", "page_id", b8("html")),
        "b9_process_text_dataset": _cleaned("documents", "doc_id", b9("text")),
        "b10_process_tweets": _cleaned("tweets", two, b10("text")),
        "b11_has_punctuation": _cleaned("tweets", two, f"regexp_matches(text, '[{PUNCTUATION}]')", "found"),
        "b12_str_contains": _cleaned("documents", "doc_id", "contains(text, 'token')", "found"),
        "b13_remove64_emojis": _cleaned("tweets", two, b13("text"), "rest"),
        "c1_emoji_counts": _with(TWEETS + ", " + DICTIONARY, f"""SELECT doc_id, pos, emoji,
  {occurrences('text', 'emoji')} AS n FROM tweets JOIN dict ON contains(text, emoji) WHERE is_64"""),
        "c2_emoji_counts_detailed": _with(TWEETS + ", " + DICTIONARY, f"""SELECT doc_id, pos, emoji, is_64,
  {occurrences('text', 'emoji')} AS n FROM tweets JOIN dict ON contains(text, emoji)"""),
        "c3_emoji_filter": _with(VERDICTS, f"SELECT {two}, verdict FROM verdicts"),
        "c3_emoji_filter_loose": _with(verdicts(60, False, False, True), f"SELECT {two}, verdict FROM verdicts"),
        "c4_emoji_single_block": _with(VERDICTS, f"""SELECT {two}, class,
  len(regexp_extract_all(replace(text, class, '⁂'), '⁂+')) <= 1 AS single FROM verdicts WHERE class IS NOT NULL"""),
        "c5_emoji_label": _with(VERDICTS, f"SELECT {two}, class, count FROM verdicts WHERE class IS NOT NULL"),
        "d1_dedup_file": _with(CLEANED, "SELECT DISTINCT source_file, text FROM cleaned"),
        "d1_dedup_all": _with(CLEANED, "SELECT DISTINCT text FROM cleaned"),
        "d2_combine_batches": " UNION ALL ".join(
            f"SELECT '{t}' AS origin, text FROM {t}" for t in ("documents", "conversations", "benchmark")
        ),
        "d3_emojis_non64": _with(WORDS, """SELECT word AS emoji FROM words GROUP BY word EXCEPT
  SELECT word FROM words GROUP BY word HAVING count(*) > 2"""),
        "labelled_tweets": _with(LABELLED, "SELECT * FROM labelled"),
        "e1_language_profiles": _with(PROFILES, "SELECT * FROM profiles"),
        "e2_language_predict": _with(
            BAYES + ", " + languages("conversations", by_turn, "text"),
            f"SELECT {by_turn}, lang, round(prob, 5) AS prob FROM answers",
        ),
        "e3_language_no_answer": _with(
            LINES + ", " + BAYES + ", " + languages("lines", two, "line"),
            f"""SELECT coalesce(a.lang, 'none') AS lang, count(*) AS n, round(avg(coalesce(prob, 0)), 4) AS prob
  FROM lines LEFT JOIN answers a USING ({two}) GROUP BY 1""",
        ),
        "prepared_tweets": _with(
            LABELLED + ", " + BAYES + ", " + languages("labelled", "source_file, text", "text"),
            """SELECT text, coalesce(a.lang, 'none') AS lang, round(coalesce(prob, 0), 5) AS prob, class, count
  FROM labelled LEFT JOIN answers a USING (source_file, text)""",
        ),
        "f0_assemble_training": _with(
            VERDICTS + ", targets(class, target) AS (VALUES " + ", ".join(f"('{e}', {t})" for e, t in LABEL_MAP) + ")",
            f"SELECT md5(length(source_file) || ':' || source_file || '|' || length(text) || ':' || text) AS row_id, {b9('text')} AS processed, target, lang FROM verdicts JOIN targets USING (class) WHERE verdict = 'kept'",
        ),
        "f0_prepared_to_features": _with(
            LABELLED + ", targets(class, target) AS (VALUES " + ", ".join(f"('{e}', {t})" for e, t in LABEL_MAP) + ")",
            f"""SELECT md5(length(source_file) || ':' || source_file || '|' || length(text) || ':' || text) AS row_id, target, 1 AS n, 64 AS dim FROM labelled JOIN targets USING (class)""",
        ),
        "f1_holdout_split": f"SELECT doc_id, lang, is_val FROM ({_split('documents', 'doc_id', 0.25)})",
        "f1_holdout_split_groups": f"""WITH keyed AS (
  SELECT doc_id, coalesce(md5('{SEED}|' || text), md5('{SEED}')) AS k FROM documents), counted AS (
  SELECT k, sum(count(*)) OVER (ORDER BY k) - count(*) AS before, sum(count(*)) OVER () AS n FROM keyed GROUP BY k)
  SELECT doc_id, before < ceil(0.25 * n) AS is_val FROM keyed JOIN counted USING (k)""",
        "f2_split_mode": f"SELECT o_orderkey FROM ({_split('orders', 'o_orderkey', 0.1)}) WHERE is_val",
        "f3_shuffle_rows": f"""SELECT doc_id, lang, n_chars,
  row_number() OVER (ORDER BY md5('{SEED}|1|' || doc_id)) - 1 AS position FROM documents""",
        "f4_assign_batches": """SELECT conv_id, turn,
  (row_number() OVER (ORDER BY conv_id, turn) - 1) // 64 AS batch FROM conversations""",
        "f4_assign_batches_shuffled": f"""SELECT doc_id,
  (row_number() OVER (ORDER BY md5('{SEED}|0|' || doc_id)) - 1) // {BATCH} AS batch FROM documents""",
        "g1_plain_text_split": f"""SELECT doc_id, len(string_split(text, ' ')) AS n,
  {digest("string_split(text, ' ')")} AS tokens FROM documents""",
        "g2_char_split": f"""SELECT doc_id, length(text) AS n, {digest("string_split(text, '')")} AS tokens
  FROM documents""",
        "g3_find_ngrams": _with(
            "d AS MATERIALIZED (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE length(text) > 2)",
            f"""SELECT doc_id, coalesce(n, 0) AS n, coalesce(grams, md5('')) AS grams FROM documents LEFT JOIN (
  SELECT doc_id, len(c) - 2 AS n,
    {digest("list_transform(list_zip(c[:-3], c[2:-2], c[3:]), lambda z: z[1] || z[2] || z[3])")} AS grams
  FROM d) USING (doc_id)""",
        ),
        "g4_word_ngrams": _with(
            WORDS + ", counted AS (SELECT word, count(*) AS m FROM words GROUP BY word)",
            f"""SELECT token, CAST(sum(m) AS BIGINT) AS n FROM (
  SELECT unnest({word_grams('word', 3)}) AS token, m FROM counted) GROUP BY token""",
        ),
        "g5_build_vocabulary": _with(RANKED, """, kept AS (SELECT token, n FROM ranked WHERE n >= 2)
  SELECT ' ' AS token, 0 AS idx, 0 AS n UNION ALL SELECT 'UNK', 1, 0
  UNION ALL SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1, n FROM kept"""),
        "g5_frequent_vocabulary": _with(RANKED, f""", kept AS (SELECT token, n FROM ranked WHERE n >= 2)
  SELECT ' ' AS token, 0 AS idx, 0 AS n UNION ALL SELECT 'UNK', 1, 0 UNION ALL SELECT * FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS idx, n FROM kept) WHERE idx < {FREQUENT}"""),
        "g6_encode_ids": _with(
            RANKED + """, placed AS (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (
  SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS t FROM documents))""",
            f"""SELECT doc_id, count(*) AS n, {digest('list(coalesce(idx, 1) ORDER BY pos)')} AS ids
  FROM placed LEFT JOIN (SELECT token, idx FROM vocabulary) USING (token) GROUP BY doc_id""",
        ),
        "g7_pad_sequence": f"""SELECT doc_id, least(len(c), 20) AS seq_len,
  {digest('list_resize(c, greatest(len(c), 20), 0)[1:20]')} AS ids FROM (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS c FROM documents)""",
        "g8_pad_words": f"""SELECT doc_id, least(len(c), {MAX_LEN}) AS seq_len,
  {digest(f"list_resize(c, greatest(len(c), {MAX_LEN}), ' ')[1:{MAX_LEN}]")} AS words FROM (
  SELECT doc_id, string_split(text, ' ') AS c FROM documents)""",
        "g9_ngram_lookup": _with(GRAMS, f"""SELECT word, l IS NOT NULL AS known, coalesce(len(l), 1) AS n,
  {digest('coalesce(l, [1])')} AS ids FROM (SELECT DISTINCT word FROM words) LEFT JOIN (
  SELECT word, list(idx ORDER BY i) AS l FROM word_hits GROUP BY word) USING (word)"""),
        "g10_unknown_words": _with(GRAMS, """SELECT word, count(*) AS n FROM words
  WHERE word NOT IN (SELECT word FROM word_hits) GROUP BY word"""),
        "g11_word_vectors_mean": _with(
            word_vectors("1.0"), f"SELECT word, {vector_columns('vector')} FROM word_vectors"
        ),
        "g12_word_vectors_attention": _with(
            word_vectors(f"exp(tanh({_dot(0)}))"), f"SELECT word, {vector_columns('vector')} FROM word_vectors"
        ),
        "g13_embedding_lookup": _with(STEPS, f"SELECT {by_turn}, pos, {vector_columns('vector')} FROM steps"),
        "g14_category_embedding": _with(
            f"""talk AS (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS t FROM conversations),
  w AS (SELECT conv_id, turn, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS pos FROM talk), cat AS (
  SELECT label AS code, [{", ".join("avg(" + " + ".join(f"embedding[{j + 1}]::DOUBLE" for j in range(i, DIM, 4)) + ")" for i in range(4))}] AS vector
  FROM embeddings GROUP BY label), joined AS (
  SELECT conv_id, turn, pos, flatten([[length(word)::DOUBLE], a.vector, b.vector]) AS v FROM w
  JOIN cat a ON a.code = length(word) % {CLASSES} JOIN cat b ON b.code = pos % {CLASSES})""",
            f"SELECT {by_turn}, pos, {vector_columns('v', 9)} FROM joined",
        ),
        "h1_pool_mean": _with(
            STEPS + ", " + pooled("1.0"), f"SELECT {by_turn}, {vector_columns('vector')} FROM pooled"
        ),
        "h2_pool_max": _with(STEPS + f""", pooled AS (SELECT {by_turn}, list(x ORDER BY d) AS vector FROM (
  SELECT {by_turn}, d, max(x) AS x FROM (
    SELECT {by_turn}, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM steps) GROUP BY ALL)
  GROUP BY ALL)""", f"SELECT {by_turn}, {vector_columns('vector')} FROM pooled"),
        "h3_pool_attention": _with(
            STEPS + ", " + pooled(f"exp(tanh({_dot(0)}))", "pos < seq_len"),
            f"SELECT {by_turn}, {vector_columns('vector')} FROM pooled",
        ),
        "h3_pool_attention_empty": _with(
            STEPS.replace("SELECT conv_id, turn, role, string_split", "SELECT nullif('c' || conv_id, 'c1') AS conv_id, turn, role, string_split", 1)
            + ", " + pooled(f"exp(greatest({_dot(0)}, 0))", "turn > 0 AND pos < seq_len"),
            f"""SELECT k.conv_id, k.turn, {vector_columns('vector')} FROM (SELECT DISTINCT conv_id, turn FROM steps) k
  LEFT JOIN pooled p ON p.conv_id IS NOT DISTINCT FROM k.conv_id AND p.turn = k.turn""",
        ),
        "h1_pool_mean_wide": _with(
            WIDE_STEPS + ", " + pooled("1.0"), f"SELECT {by_turn}, {vector_columns('vector', WIDE * DIM)} FROM pooled"
        ),
        "h2_pool_max_wide": _with(WIDE_STEPS + f""", pooled AS (SELECT {by_turn}, list(x ORDER BY d) AS vector FROM (
  SELECT {by_turn}, d, max(x) AS x FROM (
    SELECT {by_turn}, unnest(vector) AS x, generate_subscripts(vector, 1) AS d FROM steps) GROUP BY ALL)
  GROUP BY ALL)""", f"SELECT {by_turn}, {vector_columns('vector', WIDE * DIM)} FROM pooled"),
        "h3_pool_attention_wide": _with(
            WIDE_STEPS + ", " + pooled(f"exp(tanh(list_dot_product(vector, {numbers(HEADS[0] * WIDE)})))", "pos < seq_len"),
            f"SELECT {by_turn}, {vector_columns('vector', WIDE * DIM)} FROM pooled",
        ),
        "h3_pool_attention_relu": _with(
            STEPS + ", " + pooled(f"exp(greatest({_dot(0)}, 0))", "pos < seq_len"),
            f"SELECT {by_turn}, {vector_columns('vector')} FROM pooled",
        ),
        "h4_pool_attention_multi": _with(
            STEPS + ", " + ", ".join(
                pooled(f"exp(tanh({_dot(h)}))", "pos < seq_len").replace("pooled AS", f"pooled_{h} AS", 1)
                for h in range(len(HEADS))
            ),
            " UNION ALL ".join(
                f"SELECT {by_turn}, {h} AS head, {vector_columns('vector')} FROM pooled_{h}" for h in range(len(HEADS))
            ),
        ),
        "text_features": _with(
            TOKENS.replace("words AS (", "words AS MATERIALIZED (", 1) + f""", placed AS MATERIALIZED (
  SELECT doc_id, pos, least(len(t), {MAX_LEN}) AS seq_len, CASE WHEN pos < len(t) THEN t[pos + 1] ELSE ' ' END AS word
  FROM (SELECT doc_id, string_split({b9('text')}, ' ') AS t FROM documents), range(0, {MAX_LEN}) r(pos)),
  grammed AS (SELECT word, {word_grams('word', 1)} AS g FROM (SELECT DISTINCT word FROM placed)), word_hits AS (
  SELECT word, vector FROM (SELECT word, unnest(g) AS token FROM grammed) JOIN tokens USING (token)), known AS (
  {mean_vector(f"exp(tanh({_dot(0)}))", 'word', 'word_hits')}), steps AS (
  SELECT doc_id, coalesce(k.vector, (SELECT vector FROM tokens WHERE token = 'UNK')) AS vector
  FROM placed LEFT JOIN known k USING (word) WHERE pos < seq_len), pooled AS (
  {mean_vector(f"exp(tanh({_dot(1)}))", 'doc_id', 'steps')})""",
            f"SELECT doc_id, {vector_columns('vector')} FROM pooled",
        ),
        "i1_classifier_fit": f"""SELECT CASE WHEN is_val THEN 'Val' ELSE 'Train' END AS loop, count(*) AS n, true AS learns
  FROM ({_split('embeddings', 'vec_id', 0.25)}) GROUP BY 1""",
        "i2_classifier_fit_multi_head": """SELECT head, count(*) AS n,
  round(avg(((role = 'assistant')::INT = head)::INT), 6) AS share, true AS learns
  FROM conversations, (SELECT unnest([0, 1])::INT AS head) GROUP BY head""",
        "i2_predict_given_weights": _with(
            STEPS + ", " + ", ".join(
                pooled(f"exp(tanh({_dot(h)}))", "pos < seq_len").replace("pooled AS", f"pooled_{h} AS", 1) for h in (0, 1)
            ),
            f"""SELECT conv_id, turn, round(a, 5) AS logit_0, round(b, 5) AS logit_1, (b > a)::INT AS prediction FROM (
  SELECT conv_id, turn, {_dot(1, 'p.vector')} + 0.1 AS a, {_dot(2, 'q.vector')} - 0.2 AS b
  FROM pooled_0 p JOIN pooled_1 q USING (conv_id, turn))""",
        ),
        "i2_layers_given_weights": _with(
            STEPS + ", " + ", ".join(
                pooled(f"exp(tanh({_dot(h)}))", "pos < seq_len").replace("pooled AS", f"pooled_{h} AS", 1) for h in (0, 1)
            ),
            f"""SELECT conv_id, turn, round(a, 5) AS logit_0, round(b, 5) AS logit_1, (b > a)::INT AS prediction FROM (
  SELECT conv_id, turn, 1.5 * greatest(x + 0.05, 0) - 0.5 * greatest(0.3 - 2 * x, 0) AS a,
    1.5 * greatest(y + 0.05, 0) - 0.5 * greatest(0.3 - 2 * y, 0) + 0.1 AS b FROM (
    SELECT conv_id, turn, {_dot(1, 'p.vector')} AS x, {_dot(2, 'q.vector')} AS y
    FROM pooled_0 p JOIN pooled_1 q USING (conv_id, turn)))""",
        ),
        "i2_layers_fit": "SELECT count(*) AS n, true AS learns, true AS agrees FROM conversations",
        "train_history": f"""SELECT epoch, CASE WHEN is_val THEN 'Val' ELSE 'Train' END AS loop, count(*) AS n,
  true AS best_is_least, true AS learns
  FROM ({_split('embeddings', 'vec_id', 0.25)}), (SELECT unnest([0, 1, 2])::INT AS epoch) GROUP BY ALL""",
        "i3_classifier_predict": f"""SELECT vec_id, label AS target, {CLASSES}::BIGINT AS n_logits, true AS is_best
  FROM embeddings""",
        "i3_predict_given_weights": f"""SELECT vec_id, round(z[1], 5) AS logit_first, round(z[{CLASSES}], 5) AS logit_last,
  list_position(z, list_max(z)) - 1 AS prediction FROM (
  SELECT vec_id, [{", ".join(
      f"list_dot_product(embedding::DOUBLE[], {numbers(GIVEN[c : DIM * CLASSES : CLASSES])}) + {GIVEN[DIM * CLASSES + c]}"
      for c in range(CLASSES))}] AS z FROM embeddings)""",
        "train_tweets": _with(
            LABELLED + ", " + BAYES + ", " + languages("labelled", "source_file, text", "text")
            + ", targets(class, target) AS (VALUES " + ", ".join(f"('{e}', {t})" for e, t in LABEL_MAP) + f"""), framed AS (
  SELECT md5(length(source_file) || ':' || source_file || '|' || length(text) || ':' || text) AS row_id, target FROM labelled JOIN answers a USING (source_file, text)
  JOIN targets USING (class) WHERE a.lang = 'en')""",
            f"""SELECT CASE WHEN is_val THEN 'Val' ELSE 'Train' END AS loop, count(*) AS n,
  {", ".join(f"count(*) FILTER (target = {t}) AS class_{t}" for _, t in LABEL_MAP)}, true AS has_loss
  FROM ({_split('framed', 'row_id', 0.25)}) GROUP BY 1""",
        ),
        "j1_cross_entropy": """SELECT round(avg(top + ln(list_sum(list_transform(z, lambda x: exp(x - top))))
  - z[label + 1]), 6) AS loss, count(*) AS n
  FROM (SELECT embedding::DOUBLE[] AS z, list_max(embedding)::DOUBLE AS top, label FROM embeddings)""",
        "j2_topk_accuracy": """SELECT round(avg((above < 1)::INT) * 100, 6) AS top1,
  round(avg((above < 3)::INT) * 100, 6) AS top3 FROM (
  SELECT vec_id, count(*) FILTER (x > own OR (x = own AND i < label)) AS above FROM (
    SELECT vec_id, label, embedding[label + 1] AS own, unnest(embedding) AS x,
      generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY vec_id)""",
        "j3_weighted_average": _with(METRICS, f"""SELECT run, epoch, loop, arg_max(value, batch) AS last,
  round(sum(value * n), 4) AS sum, CAST(sum(n) AS BIGINT) AS count, {rounded('sum(value * n) / sum(n)')} AS avg
  FROM metrics GROUP BY ALL"""),
        "j4_running_average": _with(METRICS, f"""SELECT run, loop, batch,
  {rounded('sum(value * n) OVER w / sum(n) OVER w')} AS avg FROM metrics
  WINDOW w AS (PARTITION BY run, loop ORDER BY batch)"""),
        "j4_running_average_stream": _with(METRICS, f"""SELECT run, loop, batch AS at,
  {rounded('sum(value * n) OVER w / sum(n) OVER w')} AS avg FROM metrics
  WINDOW w AS (PARTITION BY run, loop ORDER BY batch)"""),
        "j4_running_average_late": _with(METRICS + """, parts AS (SELECT *, 3 * (batch - min(batch) OVER ())
    // (max(batch) OVER () - min(batch) OVER () + 1) AS part FROM metrics), judged AS (
  SELECT *, part = 0 AND bool_or(part = 1) OVER (PARTITION BY run, loop) AS late FROM parts)""", f"""
  SELECT run, loop, batch AS at, late, CASE WHEN NOT late THEN {rounded(
    'sum(value * n) FILTER (NOT late) OVER w / sum(n) FILTER (NOT late) OVER w')} END AS avg FROM judged
  WINDOW w AS (PARTITION BY run, loop ORDER BY batch)"""),
        "j4_running_average_null_groups": _with(METRICS, f"""SELECT run, loop, batch,
  {rounded('sum(value * n) OVER w / sum(n) OVER w')} AS avg
  FROM (SELECT * REPLACE (nullif('r' || run % 7, 'r0') AS run, nullif(value, round(value, 0)) AS value) FROM metrics)
  WINDOW w AS (PARTITION BY run, loop ORDER BY batch)"""),
        "j6_best_epochs_null_groups": """SELECT run, epoch, val_loss, least(val_loss, before) AS best_score,
  val_loss < before AS is_best FROM (
  SELECT nullif('r' || user_id % 7, 'r0') AS run, event_id AS epoch, value AS val_loss, least(100000.0, coalesce(min(value) OVER (
    PARTITION BY user_id % 7 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0)) AS before
  FROM events)""",
        "j5_epoch_summary": _with(METRICS, f"SELECT run, epoch, {_sides('value')} FROM metrics GROUP BY ALL"),
        "j6_best_epochs": """SELECT run, epoch, val_loss, least(val_loss, before) AS best_score,
  val_loss < before AS is_best FROM (
  SELECT user_id AS run, event_id AS epoch, value AS val_loss, least(100000.0, coalesce(min(value) OVER (
    PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 100000.0)) AS before
  FROM events)""",
    }
    # Texts are compared after cleaning, so the same text of two sources stays twice.
    narrowed = CLEANED.replace("FROM tweets)", f"FROM tweets WHERE NOT {JUNK})", 1)
    kept = LABELLED.replace(CLEANED, narrowed, 1)
    sql["a5_prepare_incremental"] = sql["prepared_tweets"].replace(LABELLED, kept, 1)
    once = kept.replace("SELECT DISTINCT source_file, text, class, count", "SELECT DISTINCT text, class, count", 1)
    sql["a5_prepare_incremental_all_files"] = _with(
        once + ", " + BAYES + ", " + languages("labelled", "text", "text"),
        "SELECT text, lang, round(prob, 5) AS prob, class, count FROM labelled JOIN answers USING (text)",
    )
    sql["a5_refused_records"] = sql["a2_split_bad_records"]
    return sql


ORACLE_SQL = _bodies()
