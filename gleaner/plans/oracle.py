"""SQL with the same results as the registered queries, for DuckDB over the same tables.

Left out: operators that depend on a trained model or on the MinHash functions, and ones whose result is a file
layout.  The tables hold no white space but space and line break, which the SQL relies on.
"""

from __future__ import annotations

from gleaner.functions import pii
from gleaner.functions.minhash import BASE
from gleaner.functions.charmodel import PSEUDO
from gleaner.functions.modify import TAG_OR_URL
from gleaner.functions.text import ABBREVIATIONS, CLOSERS, FULL_STOPS, OPEN_STOPS
from gleaner.functions.tokenize import PIECE
from gleaner.plans.settings import BLOCK_TAG, DOMAIN_OF_LANGUAGE, MIN_LANGUAGE_SCORE, THREE_SCRIPTS

WORDS = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
LINES = "list_filter(string_split(text, chr(10)), lambda s: trim(s, ' ' || chr(10)) <> '')"
PARAS = r"list_filter(string_split_regex(text, '\n\s*\n'), lambda s: trim(s, ' ' || chr(10)) <> '')"
STRIP = "trim({0}, ' ' || chr(10))"
CHARS = "length(array_to_string({0}, ''))"
MARKS = '[.!?"”।॥。！？]'

# Stops of abbreviations and initials are marked by U+FDD0, then each end of a sentence becomes a line break.
NO_STOP = "\ufdd0"
_ABBREVIATED = rf"(^|[^\p{{L}}\p{{M}}\p{{N}}])({'|'.join(ABBREVIATIONS)}|(?:\p{{Lu}}\.){{0,9}}\p{{Lu}})\."
_STOPS = f"regexp_replace(text, '{_ABBREVIATED}', '\\1\\2.{NO_STOP}', 'g')"
_STOPS = f"regexp_replace({_STOPS}, '([{FULL_STOPS}][{CLOSERS}]*)', '\\1' || chr(10), 'g')"
_STOPS = f"regexp_replace({_STOPS}, '([{OPEN_STOPS}][{CLOSERS}]*)\\s+([^\\p{{Ll}}{OPEN_STOPS}\\s])', '\\1' || chr(10) || '\\2', 'g')"
SENTENCES = f"list_filter(list_transform(string_split(replace({_STOPS}, '{NO_STOP}', ''), chr(10)), lambda s: trim(s, ' ' || chr(10))), lambda s: s <> '')"

UNIT = "('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0"


FIRST_HALF = f"{UNIT.format(chr(39) + 'half:' + chr(39) + ' || doc_id')} < 0.5"


def _ids(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{PIECE}'), lambda p: ('0x' || substr(md5(p), 1, 8))::BIGINT % 65536)"


TEXT_OF = "array_to_string({0}, ' ')"

PAIRS = """
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS label
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'"""
CLEAN = f"""
  SELECT * FROM (SELECT conv_id, turn, {STRIP.format("coalesce(prompt, '')")} AS prompt,
                        {STRIP.format("coalesce(label, '')")} AS label FROM ({PAIRS}))
  WHERE prompt <> '' AND label <> ''"""
USER = "'<start_of_turn>user' || chr(10) || prompt || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)"
FULL = f"{USER} || label || '<end_of_turn>'"
TOKENS = f"SELECT conv_id, turn, {_ids('(' + USER + ')')} AS u, {_ids('(' + FULL + ')')} AS f FROM ({CLEAN})"
LABELS = "list_concat(list_transform(u, lambda x: -100), f[len(u) + 1:])"

KEEP_FIRST = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM {0}) WHERE r = 1"
DUPLICATES = "SELECT doc_id, md5(text) AS _hashes, count(*) OVER (PARTITION BY md5(text)) AS n, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents"

ORDERED = f"SELECT doc_id, len({_ids('text')}) + 1 AS n FROM documents"
STARTS = f"SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ({ORDERED})"
PIECES = f"SELECT doc_id, n, start, unnest(range(start // 512, (start + n - 1) // 512 + 1)) AS sample FROM ({STARTS})"
SAMPLES = f"""
  SELECT sample, count(*) AS n_documents,
         sum(least(start + n, (sample + 1) * 512) - greatest(start, sample * 512))::BIGINT AS n_tokens
  FROM ({PIECES}) GROUP BY sample"""

LINE_BUCKETS = f"SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest({LINES}) AS line FROM documents)"
LINE_EDGES = f"""
  SELECT DISTINCT src, dst FROM (SELECT doc_id AS src, min(doc_id) OVER (PARTITION BY line) AS dst FROM ({LINE_BUCKETS}))
  WHERE src <> dst"""

# Word positions, then n-grams of them.
POSITIONS = f"""
  SELECT doc_id, n_text, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, length(text) AS n_text, {WORDS} AS w FROM {{0}})"""


def _grams(n: int, source: str = "documents") -> str:
    following = " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER d" for k in range(1, n)]])
    return f"SELECT doc_id, n_text, pos, word, {following} AS g FROM ({POSITIONS.format(source)}) WINDOW d AS (PARTITION BY doc_id ORDER BY pos)"


def _top(n: int, source: str = "documents") -> str:
    counted = f"SELECT doc_id, g, count(*) AS c FROM ({_grams(n, source)}) WHERE g IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
    best = f"SELECT doc_id, max(c * 10000000 + length(g)) AS m FROM ({counted}) GROUP BY doc_id"
    return f"""
      SELECT doc_id, {n} AS n, coalesce((m // 10000000) * (m % 10000000), 0) / length(text) AS score
      FROM {source} LEFT JOIN ({best}) USING (doc_id)"""


def _dup(n: int, source: str = "documents") -> str:
    later = f"SELECT *, CASE WHEN g IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) > 1 THEN 1 ELSE 0 END AS again FROM ({_grams(n, source)})"
    covered = f"SELECT doc_id, word, max(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM ({later})"
    total = f"SELECT doc_id, sum(length(word)) AS m FROM ({covered}) WHERE inside = 1 GROUP BY doc_id"
    return f"""
      SELECT doc_id, {n} AS n, coalesce(m, 0) / length(text) AS score FROM {source} LEFT JOIN ({total}) USING (doc_id)"""


def _line_share(condition: str) -> str:
    return f"len(list_filter({LINES}, lambda s: {condition})) / nullif(len({LINES}), 0)"


_BOILER = " OR ".join(
    f"contains(lower(s), '{p}')"
    for p in ("terms of use", "privacy policy", "cookie policy", "uses cookies", "use of cookies", "use cookies", "lorem ipsum")
)
_BOILER_PARAS = f"list_filter({PARAS}, lambda s: {_BOILER})"
_ENDS = f"(len(list_filter([({PARAS})[1], ({PARAS})[-1]], lambda s: {_BOILER})) > 0)"
URL_PATTERN = r"https?://[^\s<>\"]+|www\.[^\s<>\"]+"

# name: (score, rule on the score)
FILTERS: dict[str, tuple[str, str]] = {
    "word_count": (f"len({WORDS})", "score BETWEEN 80 AND 100000"),
    "complete_document": (f"right({STRIP.format('text')}, 1) IN ('.', '!', '?', '\"', '”')", "score = 1"),
    "symbols_to_words": (
        f"(len(regexp_extract_all(text, '#')) + len(regexp_extract_all(text, '\\.\\.\\.')) + len(regexp_extract_all(text, '…'))) / nullif(len({WORDS}), 0)",
        "score <= 0.1",
    ),
    "numbers": ("len(regexp_extract_all(text, '\\p{Nd}')) / nullif(length(text), 0)", "score <= 0.15"),
    "urls": (f"(length(text) - length(regexp_replace(text, '{URL_PATTERN}', '', 'g'))) / nullif(length(text), 0)", "score <= 0.2"),
    "white_space": ("len(regexp_extract_all(text, '\\s')) / nullif(length(text), 0)", "score <= 0.25"),
    "parentheses": ("len(regexp_extract_all(text, '[()\\[\\]{}]')) / nullif(length(text), 0)", "score <= 0.1"),
    "boilerplate": (f"CASE WHEN {_ENDS} THEN 1.0 ELSE len({_BOILER_PARAS}) / nullif(len({PARAS}), 0) END", "score <= 0.4"),
    "unique_lines": (f"len(list_distinct({LINES})) / nullif(len({LINES}), 0)", "score >= 0.7"),
    "unique_paragraphs": (f"len(list_distinct({PARAS})) / nullif(len({PARAS}), 0)", "score >= 0.7"),
    "unique_line_chars": (f"{CHARS.format(f'list_distinct({LINES})')} / nullif({CHARS.format(LINES)}, 0)", "score >= 0.8"),
    "unique_paragraph_chars": (f"{CHARS.format(f'list_distinct({PARAS})')} / nullif({CHARS.format(PARAS)}, 0)", "score >= 0.8"),
    "punctuation": (f"len(list_filter({SENTENCES}, lambda s: NOT regexp_matches(s, '{MARKS}$'))) / nullif(len({SENTENCES}), 0)", "score <= 0.85"),
    "mean_word_length": (f"{CHARS.format(WORDS)} / nullif(len({WORDS}), 0)", "score BETWEEN 3 AND 10"),
    "long_word": (f"list_max(list_transform({WORDS}, lambda w: length(w)))", "score <= 1000"),
    "ellipsis": (_line_share("regexp_matches(s, '(\\.\\.\\.|…)\\s*$')"), "score <= 0.3"),
    "bullets": (_line_share("regexp_matches(s, '^\\s*[•‣◦▪●–*-]')"), "score <= 0.9"),
}
PII_TYPES = ["EMAIL_ADDRESS", "URL", "IP_ADDRESS", "US_SSN", "PHONE_NUMBER"]
CASCADE_RULES = {**{k: v[1] for k, v in FILTERS.items() if k != "complete_document"}, "word_count": "score BETWEEN 1 AND 100000"}
TOP_LIMITS = {2: 0.2, 3: 0.18, 4: 0.16}
DUP_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
ORDER = [
    "word_count", "symbols_to_words", "numbers", "urls", "white_space", "parentheses", "boilerplate", "unique_lines",
    "unique_paragraphs", "unique_line_chars", "unique_paragraph_chars", "punctuation", "mean_word_length", "long_word",
    "ellipsis", *[f"top_{n}gram" for n in TOP_LIMITS], *[f"duplicate_{n}gram" for n in DUP_LIMITS], "bullets",
]


def _filter_sql(name: str) -> str:
    score, rule = FILTERS[name]
    return f"SELECT doc_id, score, coalesce({rule}, false) AS kept FROM (SELECT doc_id, ({score})::DOUBLE AS score FROM documents)"


def _failures(source: str = "documents") -> str:
    """``(doc_id, step)`` for each filter of the cascade that a document fails."""
    parts = []
    for step, name in enumerate(ORDER, 1):
        if name in FILTERS:
            score, rule = FILTERS[name][0], CASCADE_RULES[name]
            rows = f"SELECT doc_id, ({score})::DOUBLE AS score FROM {source}"
        else:
            n = int("".join(c for c in name if c.isdigit()))
            rows = _top(n, source) if name.startswith("top") else _dup(n, source)
            rule = f"score <= {(TOP_LIMITS | DUP_LIMITS)[n]}"
        parts.append(f"SELECT doc_id, {step} AS step FROM ({rows}) WHERE NOT coalesce({rule}, false)")
    return "\nUNION ALL\n".join(parts)


def _cascade_counts() -> str:
    names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(ORDER, 1))
    return f"""
      WITH first AS (SELECT doc_id, min(step) AS step FROM ({_failures()}) GROUP BY doc_id),
      gone AS (SELECT step, count(*) AS n FROM first GROUP BY step),
      total AS (SELECT count(*) AS n FROM documents)
      SELECT s.step, s.filter,
             total.n - coalesce((SELECT sum(n) FROM gone WHERE gone.step < s.step), 0)::BIGINT AS rows_in,
             total.n - coalesce((SELECT sum(n) FROM gone WHERE gone.step <= s.step), 0)::BIGINT AS rows_out
      FROM (VALUES {names}) s(step, filter), total"""


_WORD_CHAR = r"\p{L}\p{M}\p{N}_"
_NAME_SECOND = "[A-Z][a-z]+|" + "|".join(pii.FAMILY_NAMES)


def _listed(words: list[str], second: bool) -> str:
    """A pattern over text in which every character that is no part of a word stands between two chr(1)."""
    mark, gap = "\x01", "\x01 \x01"
    listed = "|".join(sorted((w.replace(" ", gap) for w in words), key=lambda w: (-len(w), w)))
    return f"{mark}({listed})" + (f"({gap}({_NAME_SECOND}))?" if second else "") + mark


def _marked(text: str) -> str:
    return f"(chr(1) || regexp_replace({text}, '([^{_WORD_CHAR}])', chr(1) || '\\1' || chr(1), 'g') || chr(1))"


_PERSONS, _PLACES = _listed(pii.GIVEN_NAMES, True), _listed(pii.PLACES, False)
_LUHN = """(len(hit_digits) >= 13 AND list_sum(list_transform(range(1, len(hit_digits) + 1), lambda i:
  CASE WHEN i % 2 = 1 THEN hit_digits[-i]::INT WHEN hit_digits[-i]::INT > 4 THEN 2 * hit_digits[-i]::INT - 9 ELSE 2 * hit_digits[-i]::INT END)) % 10 = 0)"""


def _resolved(types: list[str]) -> str:
    """``kept``: the spans that stay, one after the other by score, length and place; a span that meets one kept goes."""
    parts = []
    for name in types:
        if name in pii.LISTED:
            # Split at the phrases; without the marks, a hit is the phrase and the rest the text between.
            pattern, text, score = (_PERSONS if name == "PERSON" else _PLACES), _marked("text"), pii.LIST_SCORE
            clean = "list_transform({0}, lambda x: replace(x, chr(1), ''))"
        else:
            pattern, score = pii.Lexicon().address() if name == "ADDRESS" else pii.PATTERNS[name]
            text, clean = "text", "{0}"
        rest, hits = clean.format(f"string_split_regex({text}, '{pattern}')"), clean.format(f"regexp_extract_all({text}, '{pattern}')")
        found = f"SELECT doc_id, {rest} AS rest, {hits} AS hits FROM documents"
        each = f"SELECT doc_id, rest, hits, unnest(range(1, len(hits) + 1)) AS k FROM ({found})"
        begin = "(length(array_to_string(rest[1:k], '')) + length(array_to_string(hits[1:k - 1], '')))"
        spans = f"SELECT doc_id, '{name}' AS kind, {begin} AS s, {begin} + length(hits[k]) AS e, {score}::DOUBLE AS score, hits[k] AS hit FROM ({each})"
        if name == "CREDIT_CARD":
            spans = f"SELECT * EXCLUDE (hit_digits) FROM (SELECT *, regexp_extract_all(hit, '[0-9]') AS hit_digits FROM ({spans})) WHERE {_LUHN}"
        parts.append(spans)
    return f"""
      spans AS ({" UNION ALL ".join(parts)}),
      ranked AS (SELECT doc_id, list([struct_pack(s := s, e := e, kind := kind)] ORDER BY score DESC, e - s DESC, s, kind) AS found FROM spans GROUP BY doc_id),
      kept AS (
        SELECT doc_id, unnest(list_reduce(found, lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.s < x[1].e AND x[1].s < k.e)) = 0
          THEN list_concat(acc, x) ELSE acc END), recursive := true) FROM ranked)"""


def _redacted(types: list[str]) -> str:
    return f"""
      WITH {_resolved(types)},
      cut AS (SELECT doc_id, s, e, kind, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM kept),
      masked AS (
        SELECT doc_id, string_agg(substr(text, before + 1, s - before) || '<' || kind || '>', '' ORDER BY s) AS head, max(e) AS e
        FROM cut JOIN documents USING (doc_id) GROUP BY doc_id)
      SELECT doc_id, coalesce(head, '') || substr(text, coalesce(e, 0) + 1) AS text FROM documents LEFT JOIN masked USING (doc_id)"""


def _spans(name: str) -> str:
    """Spans of one type; the types of this query never overlap in the tables."""
    pattern, score = pii.PATTERNS[name]
    found = f"SELECT doc_id, string_split_regex(text, '{pattern}') AS rest, regexp_extract_all(text, '{pattern}') AS hits FROM documents"
    each = f"SELECT doc_id, rest, hits, unnest(range(1, len(hits) + 1)) AS k FROM ({found})"
    begin = "length(array_to_string(rest[1:k], '')) + length(array_to_string(hits[1:k - 1], ''))"
    return f"""
      SELECT doc_id, '{name}' AS "type", {begin} AS "start", {begin} + length(hits[k]) AS "end",
             {score}::DOUBLE AS score, hits[k] AS value FROM ({each})"""


ODD_FILTERS = ("urls", "boilerplate", "unique_paragraphs", "unique_paragraph_chars", "ellipsis", "bullets")
_BLOCKS = f"regexp_replace(html, '{BLOCK_TAG}', chr(10) || chr(10), 'g')"
_LINE = f"regexp_replace({_BLOCKS}, '<[^>]*>', ' ', 'g')"
ODD_TEXTS = f"""
  SELECT page_id * 1000 + 999 AS doc_id, concat_ws(chr(10) || chr(10), '* ' || url, {_LINE}, CASE WHEN page_id % 3 = 0 THEN {_LINE} END,
    '- see http://' || page_id || '.org ...', ['We use cookies.', 'Lorem ipsum dolor.', 'Plain end.', 'See our Privacy Policy'][page_id % 4 + 1]) AS text
  FROM pages
  UNION ALL SELECT conv_id * 1000 + turn, concat_ws(chr(10), '• ' || replace(text, chr(10), ' '), CASE WHEN turn % 2 = 0 THEN 'and so on…' END,
    'www.example.org/x') FROM conversations"""

_RANDOM = "md5('42:' || {0})"
_COMPONENTS = f"""
  WITH RECURSIVE e AS ({LINE_EDGES}),
  sym AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
  reach(a, b) AS (SELECT a, a FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a)
  SELECT a AS doc_id, min(b) AS "group" FROM reach GROUP BY a"""

_SHINGLES = "list_distinct(list_transform(range(1, greatest(length({0}) - 23, 1) + 1), lambda i: substr({0}, i, 24)))"
_TASK_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
_PASSAGES = f"""
  SELECT DISTINCT m, array_to_string(w[p : p + m - 1], ' ') AS g
  FROM (SELECT w, least(13, len(w)) AS m, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p
        FROM (SELECT {_TASK_WORDS} AS w FROM benchmark) WHERE len(w) > 0)"""
_HITS = f"""
  SELECT doc_id, p - 1 AS pos, m AS n_words
  FROM (SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p
              FROM (SELECT doc_id, {_TASK_WORDS} AS w FROM documents), (SELECT DISTINCT m FROM ({_PASSAGES})) WHERE len(w) >= m))
  WHERE (m, g) IN (SELECT (m, g) FROM ({_PASSAGES}))"""

_SECTIONS = rf"""
  WITH h AS ({_HITS}),
  tok AS (
    SELECT doc_id, generate_subscripts(ts, 1) AS k, unnest(ts) AS tok
    FROM (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS ts FROM documents WHERE doc_id IN (SELECT doc_id FROM h))),
  placed AS (
    SELECT doc_id, k, tok, regexp_matches(tok, '^[\p{{L}}\p{{N}}]') AS word,
           count(*) FILTER (regexp_matches(tok, '^[\p{{L}}\p{{N}}]')) OVER (PARTITION BY doc_id ORDER BY k) AS w
    FROM tok),
  gone_words AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n_words)) AS w FROM h),
  gone_gaps AS (SELECT DISTINCT doc_id, unnest(range(pos + 1, pos + n_words)) AS w FROM h),
  kept AS (
    SELECT doc_id, k, tok, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run
    FROM placed
    WHERE (word AND (doc_id, w - 1) NOT IN (SELECT (doc_id, w) FROM gone_words))
       OR (NOT word AND (doc_id, w) NOT IN (SELECT (doc_id, w) FROM gone_gaps))),
  pieces AS (
    SELECT doc_id, run, {STRIP.format("string_agg(tok, '' ORDER BY k)")} AS text FROM kept GROUP BY doc_id, run)
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS piece FROM pieces WHERE text <> ''
  UNION ALL SELECT doc_id, text, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)"""



def _minhash() -> str:
    """``sig``: signature per document as a list of 260 numbers; window hashes and orderings as in the library, step by step."""
    from gleaner.functions.minhash import MIX, orderings

    whole, low = "18446744073709551616::UHUGEINT", 4294967296
    terms = " + ".join(f"lead(c, {k}, 0) OVER d * {pow(BASE, k, 1 << 64)}::UHUGEINT" for k in range(24))
    steps = [f"SELECT DISTINCT doc_id, ((({terms}) + least(n, 24)::UHUGEINT) % {whole})::UBIGINT AS v, i, n FROM chars WINDOW d AS (PARTITION BY doc_id ORDER BY i)"]
    steps.append(f"SELECT DISTINCT doc_id, v FROM ({steps[-1]}) WHERE i <= greatest(n - 23, 1)")
    for m in MIX:
        steps.append(f"SELECT doc_id, ((xor(v, v >> 33)::UHUGEINT * {m}::UHUGEINT) % {whole})::UBIGINT AS v FROM ({steps[-1]})")
    steps.append(f"SELECT DISTINCT doc_id, (xor(v, v >> 33) % {low})::UBIGINT AS v FROM ({steps[-1]})")
    factor, offset = orderings(260, 42)
    minima = ", ".join(f"min((v * {f}::UBIGINT % {low} + {o}) % {low})::BIGINT" for f, o in zip(factor[:, 0].tolist(), offset[:, 0].tolist()))
    return f"""
      chars AS (SELECT doc_id, length(text) AS n, unicode(ch)::UHUGEINT AS c, i
                FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
                      FROM documents WHERE length(text) > 0)),
      sig AS (SELECT doc_id, list_transform([{minima}], lambda x: CASE WHEN x >= 2147483648 THEN x - {low} ELSE x END) AS sig FROM ({steps[-1]}) GROUP BY doc_id)"""


_BANDS = """
  bands AS (
    SELECT doc_id, band, ('0x' || substr(name, 1, 15))::BIGINT AS h1, ('0x' || substr(name, 16, 15))::BIGINT AS h2
    FROM (SELECT doc_id, band, md5(array_to_string(sig[band * 13 + 1 : band * 13 + 13], ' ')) AS name
          FROM (SELECT doc_id, sig, unnest(range(20)) AS band FROM sig))),
  edges AS (
    SELECT DISTINCT doc_id AS src, centre AS dst
    FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY band, h1, h2) AS centre FROM bands) WHERE doc_id <> centre)"""
_GROUPS = """
  sym AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
  reach(a, b) AS (SELECT a, a FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
  groups AS (SELECT a AS doc_id, min(b) AS "group" FROM reach GROUP BY a)"""

_LETTERS = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'абвгдежзийклмнопрстуфхцчшщ')"
_DOMAIN_CASES = " ".join(f"WHEN '{lang}' THEN '{domain}'" for lang, domain in DOMAIN_OF_LANGUAGE.items())


def _naive_bayes(label: str, ns: tuple[int, ...], features: int = 1 << 16, foreign: bool = False) -> str:
    """``best``: label and score of every document by naive Bayes counted over the half that it is not in.

    With ``foreign`` each text comes a second time, in letters that the model has not seen.
    """
    copies = f"""UNION ALL SELECT doc_id, true, half, regexp_replace({_LETTERS}, '[^а-я]', 'я', 'g') FROM halves""" if foreign else ""
    grams = []
    for n in ns:
        value = " + ".join(f"lead(c, {k}) OVER d * {pow(BASE, n - k, 1 << 64)}::UHUGEINT" for k in range(n))
        grams.append(f"SELECT doc_id, \"foreign\", ((({value}) % 18446744073709551616::UHUGEINT)::UBIGINT >> 32) % {features} AS f FROM chars WINDOW d AS (PARTITION BY doc_id, \"foreign\" ORDER BY i)")
    return f"""
      WITH halves AS (SELECT doc_id, text, {label} AS label, {FIRST_HALF} AS half FROM documents),
      texts AS (SELECT doc_id, false AS "foreign", half, lower(text) AS text FROM halves {copies}),
      chars AS (SELECT doc_id, "foreign", i, (unicode(ch) + 1)::UHUGEINT AS c
                FROM (SELECT doc_id, "foreign", unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i
                      FROM texts WHERE length(text) > 0)),
      freq AS (SELECT doc_id, "foreign", f, count(*) AS n FROM ({" UNION ALL ".join(grams)}) WHERE f IS NOT NULL GROUP BY ALL),
      counts AS (SELECT half, label, f, sum(n) AS n FROM freq JOIN halves USING (doc_id) WHERE NOT "foreign" GROUP BY ALL),
      totals AS (SELECT half, label, sum(n) + {features} AS total FROM counts GROUP BY ALL),
      priors AS (SELECT half, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY half)) AS prior FROM halves GROUP BY half, label),
      sums AS (
        SELECT t.doc_id, t."foreign", p.label, any_value(p.prior) + coalesce(sum(q.n * ln((coalesce(c.n, 0) + 1) / w.total)::FLOAT::DOUBLE), 0) AS total,
               coalesce(sum(q.n) FILTER (c.n > 0), 0) AS shown, coalesce(sum(q.n), 0) AS grams
        FROM texts t JOIN priors p ON p.half <> t.half JOIN totals w ON w.half = p.half AND w.label = p.label
        LEFT JOIN freq q ON q.doc_id = t.doc_id AND q."foreign" = t."foreign"
        LEFT JOIN counts c ON c.half = p.half AND c.label = p.label AND c.f = q.f
        GROUP BY t.doc_id, t."foreign", p.label),
      odds AS (SELECT *, exp(total / (grams + {PSEUDO}) - max(total / (grams + {PSEUDO})) OVER (PARTITION BY doc_id, "foreign")) AS odd FROM sums),
      best AS (
        SELECT doc_id, "foreign", arg_max(label, total) AS label,
               arg_max(odd, total) / sum(odd) * arg_max(shown, total) / greatest(max(grams), 1) AS score
        FROM odds GROUP BY doc_id, "foreign")"""


_CURATED = f"""
  SELECT d.doc_id, len({WORDS})::BIGINT AS word_count FROM documents d
  WHERE len({WORDS}) BETWEEN 80 AND 100000 AND {FILTERS['complete_document'][0]}
    AND doc_id NOT IN (SELECT doc_id FROM ({_top(2)}) WHERE score > 0.2)
    AND doc_id NOT IN (SELECT doc_id FROM ({_top(3)}) WHERE score > 0.18)
    AND doc_id NOT IN (SELECT doc_id FROM ({_top(4)}) WHERE score > 0.16)"""
_TEN_WORDS = f"len({WORDS}) >= 10 AND doc_id NOT IN (SELECT doc_id FROM ({_failures()}))"
_UNIQUE_LINES = FILTERS["unique_lines"][0]

ORACLE: dict[str, str] = {
    "read_parquet_with_file_name": "SELECT doc_id, lang, 'documents.parquet' AS file_name FROM documents",
    "read_json_with_file_name": "SELECT doc_id, text, lang, true AS has_file_name FROM documents",
    "read_json_files": "SELECT doc_id, text FROM documents",
    "read_gzipped_json": "SELECT doc_id, text FROM documents",
    "read_recursively": "SELECT doc_id FROM documents",
    "read_projected_columns": "SELECT doc_id, source FROM documents",
    "files_without_required_columns": "SELECT 'shard-3' AS shard, 'text' AS missing, count(*) AS n_rows FROM documents WHERE doc_id % 4 = 3",
    "write_json_per_source_file": "SELECT doc_id, source || ' ' || lang || '.json' AS file_name, source || ' ' || lang || '.json' AS written_to FROM documents",
    "write_json_parts": "SELECT doc_id, text FROM documents",
    "write_parquet_parts": "SELECT doc_id, text FROM documents",
    "separate_by_language": "SELECT lang, count(*) AS n_documents FROM documents GROUP BY lang",
    "write_equal_shards": "SELECT 8 AS n_shards, count(*) AS n_documents FROM documents",
    "write_train_validation_json": f"""
      SELECT prompt, label, CASE WHEN {UNIT.format("'42:' || conv_id || ':' || turn")} < 0.02 THEN 'validation' ELSE 'train' END AS split
      FROM ({CLEAN})""",
    "write_combined_text_json": f"SELECT coalesce(prompt, '') || chr(10) || coalesce(label, '') AS text FROM ({PAIRS})",
    "prepare_prompt_label_files": f"SELECT count(*) AS n_rows FROM ({CLEAN})",
    "combine_prompt_label_files": f"SELECT coalesce(prompt, '') || chr(10) || coalesce(label, '') AS text FROM ({PAIRS})",
    "write_labelled_lines": "SELECT '__label__hq ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS value FROM documents",
    "exact_duplicate_table_on_disk": f"SELECT doc_id, _hashes FROM ({DUPLICATES}) WHERE n > 1",
    "tokenized_corpus_on_disk": f"""
      SELECT doc_id, {TEXT_OF.format('ids')} AS tokens, len(ids) AS n_tokens
      FROM (SELECT doc_id, list_append({_ids('text')}, 65536) AS ids FROM documents)""",
    "keep_text_column": "SELECT text FROM documents",
    "map_question_answer_columns": PAIRS,
    "unpack_language_score": _naive_bayes("lang", (1, 2, 3)) + " SELECT doc_id, round(score, 2) AS score, upper(label) AS language FROM best",
    "clean_prompt_label_pairs": CLEAN,
    "combined_prompt_label": f"SELECT conv_id, turn, coalesce(prompt, '') || chr(10) || coalesce(label, '') AS text FROM ({PAIRS})",
    "score_and_filter": f"SELECT doc_id, len({WORDS}) AS word_count FROM documents WHERE len({WORDS}) BETWEEN 80 AND 100000",
    "modify_text": "SELECT doc_id, lower(text) AS text FROM documents",
    "own_text_modifier": f"SELECT doc_id, array_to_string({WORDS}, ' ') AS text FROM documents",
    "own_score_and_keep": f"""
      SELECT doc_id, share FROM (SELECT doc_id, len(list_distinct({WORDS})) / nullif(len({WORDS}), 0) AS share FROM documents) WHERE share >= 0.7""",
    "sequential_steps": f"SELECT doc_id FROM documents WHERE len({WORDS}) BETWEEN 80 AND 100000",
    "heuristic_cascade": f"SELECT doc_id FROM documents WHERE {_TEN_WORDS}",
    "cascade_stage_counts": _cascade_counts(),
    "curate_web_corpus": _CURATED,
    "curate_pretraining_corpus": f"""
      SELECT doc_id, 'HI-' || lpad((SELECT count(*) FROM documents e WHERE e.doc_id < d.doc_id)::VARCHAR, 10, '0') AS id
      FROM documents d WHERE doc_id IN ({KEEP_FIRST.format('documents')}) AND {_TEN_WORDS}""",
    "remove_listed_ids": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "bucket_star_edges": LINE_EDGES,
    "document_counts_by_stage": f"""
      WITH s AS (SELECT len({WORDS}) BETWEEN 80 AND 100000 AS a, {FILTERS['complete_document'][0]} AS b FROM documents)
      SELECT 1 AS step, 'word_count' AS filter, count(*) AS rows_in, count(*) FILTER (a) AS rows_out FROM s
      UNION ALL SELECT 2, 'complete_document', count(*) FILTER (a), count(*) FILTER (a AND b) FROM s""",
    "documents_per_language": f"""
      WITH kept AS (SELECT doc_id, text, lang FROM documents
                    WHERE len({WORDS}) BETWEEN 80 AND 100000 AND {FILTERS['complete_document'][0]})
      SELECT lang, count(*) AS n_documents FROM kept WHERE doc_id IN ({KEEP_FIRST.format('kept')}) GROUP BY lang""",
    "language_counts": "SELECT lang, count(*) AS n_documents FROM documents GROUP BY lang",
    "validation_report": f"""
      SELECT count(*) AS total_rows, count(*) FILTER (p <> '' AND l <> '') AS checked_rows,
             count(*) FILTER (p = '') AS empty_prompts, count(*) FILTER (p <> '' AND l = '') AS empty_labels,
             count(*) FILTER (p <> '' AND l <> '' AND n > 512) AS over_length,
             count(*) FILTER (p <> '' AND l <> '' AND n > 512) * 100.0::DOUBLE / count(*) AS over_length_percent
      FROM (SELECT prompt AS p, label AS l, len({_ids('(' + FULL + ')')}) AS n
            FROM (SELECT {STRIP.format("coalesce(prompt, '')")} AS prompt, {STRIP.format("coalesce(label, '')")} AS label FROM ({PAIRS})))""",
    "split_row_counts": f"""
      SELECT CASE WHEN {UNIT.format("'42:' || conv_id || ':' || turn")} < 0.02 THEN 'validation' ELSE 'train' END AS split, count(*) AS n_rows
      FROM ({CLEAN}) GROUP BY 1""",
    "token_budget": f"""
      SELECT count(*) AS n_documents, sum(n)::BIGINT AS n_tokens, 8192::BIGINT AS tokens_per_step,
             ceil(sum(n) / 8192.0)::BIGINT AS steps_by_tokens, ceil(count(*) / 16.0)::BIGINT AS steps_by_documents
      FROM ({ORDERED})""",
    "rows_beyond_first": """
      SELECT doc_id, part FROM (
        SELECT doc_id, lang || '/' || source AS part, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents)
      WHERE r > 1""",
    "add_sequential_id": "SELECT doc_id, 'FR_data-' || lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 10, '0') AS id FROM documents",
    "add_id_by_position": "SELECT doc_id, 'HI-' || lpad((row_number() OVER (ORDER BY doc_id) + 99)::VARCHAR, 10, '0') AS id FROM documents",
    "packed_sample_lengths": SAMPLES,
    "packed_samples": f"""
      WITH t AS (SELECT doc_id, list_append({_ids('text')}, 65536) AS ids FROM documents),
      s AS (SELECT doc_id, ids, coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM t),
      e AS (SELECT start + generate_subscripts(ids, 1) - 1 AS place, unnest(ids) AS token FROM s)
      SELECT place // 512 AS sample, string_agg(token::VARCHAR, ' ' ORDER BY place) AS tokens FROM e GROUP BY 1""",
    "contiguous_split": """
      SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor(count(*) OVER () * 0.995) THEN 'train' ELSE 'validation' END AS split
      FROM documents""",
    "head_of_corpus": "SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 3",
    "sorted_input_files": """
      SELECT doc_id, printf('shard-%02d', doc_id % 3) AS shard, row_number() OVER (ORDER BY doc_id % 3, doc_id) - 1 AS place FROM documents""",
    "row_at_global_index": "SELECT doc_id, text, 123::BIGINT AS ordinal FROM documents ORDER BY doc_id LIMIT 1 OFFSET 123",
    "shuffled_corpus": f"SELECT doc_id, source FROM documents ORDER BY {_RANDOM.format('doc_id')}",
    "sample_about_n": f"SELECT doc_id, lang FROM documents WHERE {UNIT.format(chr(39) + '42:' + chr(39) + ' || doc_id')} * (SELECT count(*) FROM documents) < 100",
    "sample_exactly_n": f"SELECT doc_id, lang FROM documents ORDER BY {_RANDOM.format('doc_id')}, doc_id LIMIT 100",
    "sample_exactly_a_third": f"""
      SELECT doc_id, lang FROM (SELECT *, row_number() OVER (ORDER BY {_RANDOM.format('doc_id')}, doc_id) AS place FROM documents)
      WHERE place <= (SELECT count(*) // 3 FROM documents)""",
    "first_n_documents": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 150",
    "pick_among_first_valid": f"""
      SELECT conv_id, turn, prompt, label FROM (SELECT * FROM ({CLEAN}) ORDER BY conv_id * 1000 + turn LIMIT 20)
      ORDER BY {_RANDOM.format('(conv_id * 1000 + turn)')} LIMIT 1""",
    "capped_validation_samples": f"SELECT * FROM ({SAMPLES}) ORDER BY sample LIMIT 64",
    "bernoulli_split": f"SELECT doc_id, CASE WHEN {UNIT.format(chr(39) + '42:' + chr(39) + ' || doc_id')} < 0.02 THEN 'validation' ELSE 'train' END AS split FROM documents",
    "union_of_corpora": "SELECT text FROM documents UNION ALL SELECT text FROM benchmark",
    "every_sample_twice": "SELECT doc_id, lang FROM documents UNION ALL SELECT doc_id, lang FROM documents",
    **{f"filter_{name}": _filter_sql(name) for name in FILTERS},
    **{f"filter_{name}_on_pages": _filter_sql(name).replace("FROM documents", f"FROM ({ODD_TEXTS})") for name in ODD_FILTERS},
    "split_sentences": f"SELECT doc_id, unnest(range(len(found)))::INT AS place, unnest(found) AS sentence FROM (SELECT doc_id, {SENTENCES} AS found FROM documents)",
    "filter_top_ngrams": "\nUNION ALL\n".join(_top(n) for n in TOP_LIMITS),
    "filter_duplicate_ngrams": "\nUNION ALL\n".join(_dup(n) for n in DUP_LIMITS),
    "unify_quotes_and_tags": f"""
      SELECT page_id, regexp_replace(translate(html, '‘’“”' || chr(9), '''''""' || ' '), '{TAG_OR_URL}', '', 'g') AS text FROM pages""",
    "remove_urls": f"SELECT page_id, regexp_replace('see ' || url || ' ''now''', '{TAG_OR_URL}', '', 'g') AS text FROM pages",
    "repair_misread_documents": f"SELECT doc_id, text || '{THREE_SCRIPTS}' AS text FROM documents",
    "reformat_unicode": """
      SELECT page_id, nfc_normalize(replace(replace(replace(replace(regexp_replace(html, '[<>]', ' ', 'g'),
        '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&')) AS text FROM pages""",
    "label_prefix": "SELECT doc_id, '__label__lq ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM documents",
    "chat_turn_template": f"""
      SELECT conv_id, turn, {USER} AS user_part, {FULL} AS full_text
      FROM (SELECT conv_id, turn, {STRIP.format('prompt')} AS prompt, {STRIP.format('label')} AS label FROM ({PAIRS}))""",
    "tokenize_texts": f"SELECT doc_id, {TEXT_OF.format(_ids('text'))} AS ids FROM documents",
    "answer_only_loss_mask": f"SELECT conv_id, turn, {TEXT_OF.format(LABELS)} AS labels FROM ({TOKENS})",
    "truncate_and_pad": f"""
      WITH t AS (SELECT conv_id, turn, f[:512] AS ids, ({LABELS})[:512] AS labels,
                        (row_number() OVER (ORDER BY conv_id, turn) - 1) // 8 AS batch FROM ({TOKENS})),
      m AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS longest FROM t)
      SELECT conv_id, turn, batch,
             array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda i: 0)), ' ') AS input_ids,
             array_to_string(list_concat(labels, list_transform(range(longest - len(labels)), lambda i: -100)), ' ') AS labels
      FROM m""",
    "over_length_flag": f"SELECT conv_id, turn, len(f) > 512 AS over_length FROM ({TOKENS})",
    "pii_spans": "\nUNION ALL\n".join(_spans(t) for t in PII_TYPES),
    "pii_redaction": _redacted(PII_TYPES),
    "pii_redaction_of_persons": _redacted(["PERSON"]),
    "pii_redaction_of_all_types": _redacted(pii.ENTITIES),
    "identify_language": _naive_bayes("lang", (1, 2, 3)) + " SELECT doc_id, upper(label) AS language FROM best",
    "drop_unsure_language": _naive_bayes("lang", (1, 2, 3), foreign=True)
    + f' SELECT doc_id, "foreign", upper(label) AS language FROM best WHERE score >= {MIN_LANGUAGE_SCORE}',
    "classify_domain": _naive_bayes(f"CASE lang {_DOMAIN_CASES} END", (4, 6)) + " SELECT doc_id, label AS domain_pred FROM best",
    "quality_training_set": f"""
      WITH g AS (SELECT doc_id, text, quality, count(*) OVER (PARTITION BY quality) AS n FROM documents JOIN labels USING (doc_id))
      SELECT doc_id, CASE quality WHEN 1 THEN '__label__hq ' ELSE '__label__lq ' END || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text
      FROM g WHERE {UNIT.format(chr(39) + '42:' + chr(39) + ' || doc_id')} * n < 200""",
    "keep_by_quality_draw": f"""
      SELECT doc_id, quality_score FROM (
        SELECT doc_id, {_UNIQUE_LINES} * ({UNIT.format("'q:' || doc_id")}) AS quality_score,
               pow(1.0::DOUBLE - {UNIT.format("'42:' || doc_id")}, -1.0::DOUBLE / 9.0) - 1.0 AS draw FROM documents)
      WHERE draw > 1.0 - quality_score""",
    "keep_by_quality_threshold": f"SELECT doc_id, {_UNIQUE_LINES} AS unique_lines FROM documents WHERE {_UNIQUE_LINES} >= 0.9",
    "exact_duplicates": f"SELECT doc_id, _hashes FROM ({DUPLICATES}) WHERE n > 1",
    "exact_duplicates_to_remove": f"SELECT doc_id, _hashes FROM ({DUPLICATES}) WHERE r > 1",
    "remove_exact_duplicates": f"SELECT doc_id, lang FROM documents WHERE doc_id IN ({KEEP_FIRST.format('documents')})",
    "components_of_shared_lines": _COMPONENTS,
    "edge_similarity": f"""
      WITH e AS ({LINE_EDGES}),
      s AS (SELECT doc_id, unnest({_SHINGLES.format('text')}) AS g FROM documents WHERE doc_id IN (SELECT src FROM e UNION SELECT dst FROM e)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      c AS (SELECT e.src, e.dst, count(b.g) AS c FROM e JOIN s a ON a.doc_id = e.src LEFT JOIN s b ON b.doc_id = e.dst AND b.g = a.g GROUP BY ALL)
      SELECT c.src, c.dst, c.c / (x.n + y.n - c.c) AS similarity FROM c JOIN n x ON x.doc_id = c.src JOIN n y ON y.doc_id = c.dst""",
    "minhash_signatures": f"WITH {_minhash()} SELECT doc_id, md5(array_to_string(sig, ' ')) AS signature FROM sig",
    "lsh_buckets": f"WITH {_minhash()}, {_BANDS} SELECT doc_id, band::INT AS band, h1, h2 FROM bands",
    "lsh_edges": f"WITH {_minhash()}, {_BANDS} SELECT src, dst FROM edges",
    "fuzzy_duplicates": f"WITH RECURSIVE {_minhash()}, {_BANDS}, {_GROUPS} SELECT * FROM groups",
    "remove_fuzzy_duplicates": f"""
      WITH RECURSIVE {_minhash()}, {_BANDS}, {_GROUPS}
      SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM groups WHERE doc_id <> "group")""",
    "confirmed_fuzzy_duplicates": f"""
      WITH RECURSIVE {_minhash()}, {_BANDS.rsplit("edges AS", 1)[0]}
      pairs AS (SELECT DISTINCT a.doc_id AS src, b.doc_id AS dst FROM bands a JOIN bands b USING (band, h1, h2) WHERE a.doc_id > b.doc_id),
      s AS (SELECT doc_id, unnest({_SHINGLES.format('text')}) AS g FROM documents WHERE doc_id IN (SELECT src FROM pairs UNION SELECT dst FROM pairs)),
      n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
      c AS (SELECT p.src, p.dst, count(b.g) AS c FROM pairs p JOIN s a ON a.doc_id = p.src LEFT JOIN s b ON b.doc_id = p.dst AND b.g = a.g GROUP BY ALL),
      edges AS (SELECT c.src, c.dst FROM c JOIN n x ON x.doc_id = c.src JOIN n y ON y.doc_id = c.dst WHERE c.c / (x.n + y.n - c.c) >= 0.8),
      {_GROUPS} SELECT * FROM groups""",
    "contaminated_positions": _HITS,
    "remove_contaminated_sections": _SECTIONS,
    "remove_contaminated_documents": f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({_HITS}))",
}

ORACLE["documents_per_language_in_stages"] = ORACLE["documents_per_language"]
