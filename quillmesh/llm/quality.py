"""Quality rules, lines first.

Every line with a word is judged by three kinds of rules: punctuation (it must end
like a sentence unless it is the text's last, and must not be mostly marks),
navigation (separators between short items) and boilerplate (fixed phrases). Lines that
fail are taken out; a document that loses more than ``max_lost`` of its
non-blank characters to that is rejected, as is one that fails the base measures.

Works on one text at a time in Python workers, without a shuffle. A null or empty
text has no words and fails the base measures (n_words < 50). Repeated rows give
repeated results, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that may end a sentence or a quotation.
ENDINGS = tuple(".!?…:;。！？\"'”’»)]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SYMBOLS = re.compile(r"[#*$%&|<>]").findall
_MARKS = re.compile(r"[!?#*$%&|<>=_~^{}\[\]\\/@+]").findall
_SEPARATORS = frozenset(("|", "»", "›", ">", "•", "·", "/", "::", "->", "=>"))
_BLANKS = " \t\r\x0b\x0c"
#: Phrases of pages about pages in English, German, French and Spanish, lower-cased.
PHRASES = (
    "all rights reserved", "privacy policy", "cookie policy", "cookie settings", "we use cookies", "terms of use", "terms of service",
    "lorem ipsum", "enable javascript", "javascript is disabled", "javascript is required", "subscribe to our", "sign up for our",
    "click here", "share this", "share on", "follow us", "skip to content", "skip to main content", "back to top",
    "alle rechte vorbehalten", "datenschutzerklärung", "wir verwenden cookies", "nutzungsbedingungen", "javascript aktivieren",
    "newsletter abonnieren", "hier klicken", "zum inhalt springen", "nach oben", "folgen sie uns",
    "tous droits réservés", "politique de confidentialité", "nous utilisons des cookies", "conditions d'utilisation", "activer javascript",
    "abonnez-vous", "cliquez ici", "aller au contenu", "haut de page", "suivez-nous",
    "todos los derechos reservados", "política de privacidad", "utilizamos cookies", "términos de uso", "active javascript",
    "suscríbete", "haz clic aquí", "ir al contenido", "volver arriba", "síguenos",
)
_BOILERPLATE = re.compile("|".join(map(re.escape, PHRASES)) + r"|©|\(c\) (?:19|20)\d\d").search


def line_verdict(line: str, last: bool = False) -> str | None:
    """Why a line with words fails (punctuation, navigation, boilerplate), or null."""
    words = _WORDS(line)
    if _BOILERPLATE(line.lower()):
        return "boilerplate"
    if sum(w in _SEPARATORS for w in words) * 4 >= len(words):
        return "navigation"
    marks = len(_MARKS(line))
    if marks >= 3 and marks * 2 > len(words):
        return "punctuation"
    if not last and len(words) > 3 and not words[-1].endswith(ENDINGS):
        return "punctuation"
    return None


def repeated_words(words: list[str]) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    at = [ids.setdefault(w, len(ids)) for w in words]
    base = len(ids)
    keys = [(a * base + b) * base + c for a, b, c in zip(at, at[1:], at[2:])]
    first: dict[int, int] = {}
    twice = set()
    for key in keys:
        if first.setdefault(key, 0):
            twice.add(key)
        first[key] = 1
    if not twice:
        return 0
    mask = [k in twice for k in keys]
    return sum(a or b or c for a, b, c in zip([*mask, False, False], [False, *mask, False], [False, False, *mask]))


def judge(text: str | None, max_lost: float = 0.5) -> dict:
    """All measures, the cleaned text and the verdict of one text."""
    text = text or ""
    words = _WORDS(text)
    lines = text.split("\n")
    with_words = [bool(_WORDS(x)) for x in lines]
    seen, duplicates = set(), 0
    for line in compress(lines, with_words):
        duplicates += line in seen
        seen.add(line)
    repeats = repeated_words(words)
    last = max((i for i, w in enumerate(with_words) if w), default=-1)
    failed = {i: v for i, w in enumerate(with_words) if w and (v := line_verdict(lines[i], i == last))}
    total = sum(len(x.strip(_BLANKS)) for x in lines)
    lost = sum(len(lines[i].strip(_BLANKS)) for i in failed)
    base_failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(_SYMBOLS(text)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= max_lost * total,
        "n_lines_failed": len(failed),
        "lost_chars": lost,
        "text": "\n".join(x for i, x in enumerate(lines) if i not in failed),
    }


_KINDS = {
    "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint",
    "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean", "n_lines_failed": "bigint",
    "lost_chars": "bigint", "text": "string",
}


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, with_text: bool = True
) -> DataFrame:
    """(doc_id, measures, verdict[, cleaned text]) of every row."""
    names = [c for c in _KINDS if with_text or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
        for batch in batches:
            found = [judge(t.as_py(), max_lost) for t in batch.column(1)]
            made = [pa.array([x[c] for x in found], arrow[_KINDS[c]]) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", *names])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{c} {_KINDS[c]}" for c in names))


#: The measures and verdict (max_lost 0.5) in DuckDB SQL, from documents.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
m AS (SELECT rid, pos, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS v,
        length(trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS size FROM l),
n AS (SELECT *, max(pos) OVER (PARTITION BY rid) AS last, len(regexp_extract_all(line, '[!?#*$%&|<>=_~^{{}}\\[\\]\\\\/@+]')) AS marks FROM m WHERE len(v) > 0),
j AS (SELECT *, regexp_matches(lower(line), '<phrases>|©|\\(c\\) (19|20)[0-9][0-9]')
        OR len(list_filter(v, lambda x: x IN ('|', '»', '›', '>', '•', '·', '/', '::', '->', '=>'))) * 4 >= len(v)
        OR (marks >= 3 AND marks * 2 > len(v))
        OR (pos <> last AND len(v) > 3 AND NOT contains('.!?…:;。！？"''”’»)]', right(v[-1], 1))) AS bad FROM n),
s AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (bad) AS n_lines_failed, coalesce(sum(size) FILTER (bad), 0) AS lost_chars FROM j GROUP BY rid),
t AS (SELECT rid, sum(size) AS total FROM m GROUP BY rid),
f AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_failed, 0) AS n_lines_failed,
        coalesce(lost_chars, 0) AS lost_chars, total FROM d JOIN w USING (rid) JOIN t USING (rid) LEFT JOIN s USING (rid) LEFT JOIN r USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * total AS kept,
       n_lines_failed::BIGINT AS n_lines_failed, lost_chars::BIGINT AS lost_chars FROM f
""".replace("{{", "{").replace("}}", "}").replace("<phrases>", "|".join(PHRASES).replace("'", "''"))
