"""Operator 2, line-first cleaning.

Every line is judged on its own by punctuation, navigation and boilerplate rules; lines that fail are removed, and a
document that loses more than MAX_LOST of its word characters that way is rejected. A document that fails the base rules
(under 20 words, or over 30 % of its words in repeated 8-word windows) is rejected whatever its lines say.

Null texts are empty texts; they have no words and are rejected. Very long texts are judged whole, a batch at a time.
Repeated rows are judged each, so there are no ties. An empty table gives no rows. Only the columns asked for are read;
judged() gives them first, and where one of them has the name of a result column, the result replaces it. clean() keeps all
columns of the input as they are, whatever their names, but for text and n_chars.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, record_batch, slices, utf8, SPACES

MAX_LOST = 0.5
#: clean()'s words up to which a line with a boilerplate phrase fails; judged() and op2 fail such lines of any length.
PHRASE_WORDS = 30
SYMBOLS = b"#*$%&|<>"
#: Fixed values of the boilerplate rule: lower-case phrases.
PHRASES = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "follow us on",
    "licensed under the", "log in to", "lorem ipsum", "powered by", "privacy policy", "read more", "share this",
    "sign up for", "subscribe to", "terms of service", "terms of use", "use of cookies",
)
_LOUD = re.compile(rb"[!?]{2,}$")
_SEPARATOR = re.compile(rb"[|/<>=~_-]+|\xc2[\xb7\xbb\xab]|\xe2\x80\xa2")
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")
_ENDED = re.compile(rb"(?:[.!?:;,\"')\]]|\xe2\x80[\xa6\x9d\x99]|\xc2\xbb|\xe3\x80\x82)$")
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 2**64) for k in range(1, 9)], dtype=np.uint64)


def line_fails(line: bytes, words: list[bytes], phrase_words: int | None = None) -> bool:
    """The rules for one line that has words. A phrase fails a line of up to phrase_words words (of any number where that is None)."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if symbols > 2 and 2 * symbols > n or not _LETTER.search(line):
        return True  # punctuation
    if b"!!" in line or b"??" in line or b"!?" in line or b"?!" in line:
        if 2 * sum(1 for w in words if _LOUD.search(w)) > n:
            return True
    if 3 * sum(1 for w in words if _SEPARATOR.fullmatch(w)) > n:
        return True  # navigation
    if n <= 3 and not _ENDED.search(words[-1]):
        return True
    if n >= 4 and 2 * sum(map(bytes.__eq__, words[1:], words)) > n:  # the same word again and again
        return True
    return (phrase_words is None or n <= phrase_words) and _PHRASE.search(line.lower()) is not None  # boilerplate


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of this width which occurs twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    windows = np.zeros(n, np.uint64)
    for k in range(width):
        windows += ids[k : k + n] * _POWERS[k]
    order = np.sort(windows)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(windows, twice))
    texts = [tuple(words[i : i + width]) for i in found.tolist()]  # hashes only propose; the words decide
    count = Counter(texts)
    starts = np.zeros(len(words) + 1, np.int64)
    for i, t in zip(found.tolist(), texts, strict=True):
        if count[t] > 1:
            starts[i] += 1
            starts[i + width] -= 1
    return int(np.count_nonzero(np.cumsum(starts)))


def judge(text: str | None, with_text: bool = False, phrase_words: int | None = None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lines_removed, chars_removed, cleaned."""
    text = text or ""
    raw = utf8(text)
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACES)))
    repeats = repeated_words(words)
    base_failed = len(words) < 20 or 100 * repeats > 30 * len(words)
    seen: set[bytes] = set()
    n_dup = removed = lost = 0
    stay = []
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            if with_text:
                stay.append(line)
            continue
        dup = line in seen
        n_dup += dup
        seen.add(line)
        if dup or line_fails(line, own, phrase_words):
            removed += 1
            lost += sum(len(w.decode("utf-8", "surrogatepass")) for w in own)
        elif with_text:
            stay.append(line)
    kept = not base_failed and lost <= MAX_LOST * word_chars
    cleaned = (b"\n".join(stay).decode("utf-8", "surrogatepass") if removed else text) if with_text else None
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), word_chars, symbols, n_dup, repeats, base_failed, kept, removed, lost, cleaned


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lines_removed long, chars_removed long"


def judged(docs: DataFrame, text: str = "text", carry: list[str] | None = None, with_text: bool = False, phrase_words: int | None = None) -> DataFrame:
    """The carried columns (default: all), then the result columns and, if asked for, cleaned_text."""
    out = RESULT + (", cleaned_text string" if with_text else "")
    made = {x.split()[0] for x in out.split(", ")}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    source = docs.select(F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{c}`") for c in carry])
    kinds = [f for f in source.schema.fields[1:]]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + [out])

    def run(parts):
        schema = batches(out)
        import pyarrow as pa

        for part in slices(parts):
            rows = [judge(t, with_text, phrase_words) for t in part.column(0).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(10)]
            own = record_batch(schema, columns[: len(schema)])
            yield pa.RecordBatch.from_arrays([*part.columns[1:], *own.columns], names=[*[f.name for f in kinds], *schema.names])

    return source.mapInArrow(run, ddl)


def clean(docs: DataFrame, phrase_words: int | None = PHRASE_WORDS) -> DataFrame:
    """The documents that are kept, with the columns they had: text without its failed lines, n_chars to match.

    A phrase in a line of over phrase_words words is taken for prose: one "read more" is no reason to drop a whole paragraph.
    """
    inner = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    kept = judged(inner, f"_c{docs.columns.index('text')}", with_text=True, phrase_words=phrase_words).where("kept")

    def column(k: int, c: str):
        if c == "text":
            return F.col("cleaned_text").alias(c)
        if c == "n_chars":
            return F.char_length("cleaned_text").cast(docs.schema[k].dataType).alias(c)
        return F.col(f"_c{k}").alias(c)

    return kept.select(*[column(k, c) for k, c in enumerate(docs.columns)])


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judged(table(spark, sf_dir, "documents"), carry=["doc_id"])


def _sql() -> str:
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in PHRASES)
    word = r"[^\x20\x09-\x0D]+"
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce("text", '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{word}') AS ws FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS no FROM d),
l AS (SELECT rid, no, line, regexp_extract_all(line, '{word}') AS ws, row_number() OVER (PARTITION BY rid, line ORDER BY no) AS seen,
  length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym FROM lines WHERE regexp_matches(line, '{word}')),
f AS (SELECT rid, seen > 1 AS dup, length(array_to_string(ws, '')) AS chars,
  seen > 1 OR (sym > 2 AND 2 * sym > len(ws)) OR NOT regexp_matches(line, '[A-Za-z\x{{80}}-\x{{10FFFF}}]')
  OR 2 * len(list_filter(ws, lambda x: regexp_matches(x, '[!?][!?]+$'))) > len(ws)
  OR 3 * len(list_filter(ws, lambda x: regexp_full_match(x, '[|/<>=~_-]+|[·»«•]'))) > len(ws)
  OR (len(ws) <= 3 AND NOT regexp_matches(ws[-1], '[.!?:;,"'')\]…”’»。]$'))
  OR (len(ws) >= 4 AND 2 * len(list_filter(range(2, len(ws) + 1), lambda k: ws[k] = ws[k - 1])) > len(ws)) OR {phrases} AS fails FROM l),
g AS (SELECT rid, count(*) FILTER (dup) AS dups, count(*) FILTER (fails) AS removed, coalesce(sum(chars) FILTER (fails), 0) AS lost FROM f GROUP BY rid),
r AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(removed, 0) AS lines_removed, coalesce(lost, 0) AS chars_removed
  FROM d JOIN w USING (rid) LEFT JOIN covered USING (rid) LEFT JOIN g USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * chars_removed <= word_chars AS kept,
  lines_removed::BIGINT AS lines_removed, chars_removed::BIGINT AS chars_removed FROM r"""


SQL = _sql()
