"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text is rejected.

A line with a word is judged by, in this order (the first that fails names the line):

* ``navigation``: separators such as ``|`` make up over a quarter of its tokens (at least two of them);
* ``symbols``: over three tenths of its words carry one of ``#*$%&|<>``;
* ``shouting``: over half of its words end in ``!!``, or over seven tenths of its letters are capitals (three words at least);
* ``repetition``: of ten words or more, over half stand directly after the same word, or under a fifth are different, on
  average over all windows of ``SPAN`` consecutive words (of fewer words, over the line);
* ``boilerplate``: known notices, see BOILERPLATE, make up a fifth of its words or more; one mention in a longer line is
  no reason;
* ``duplicate``: equal to an earlier line of the text;
* ``punctuation``: its last word ends with no mark of ENDS, and under one in 40 of its words does, whatever its length.

Lines without a word don't count. Words are split by ASCII white space. A document is kept unless it fails the base
rules (under 50 words, or over half of its words in repeated 3-word windows) or the lines kept hold under half of its
words' characters.

Defined results: a null text equals an empty one, which fails the base rules; repeated rows are judged alike; very
long texts are judged whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import WORD, id_and_text, pieces

WORDS = re.compile(WORD)
SYMBOLS = re.compile(r"[#*$%&|<>]")
# Marks that part the entries of a menu, and notices of web pages.
SEPARATORS = {"|", "||", "·", "•", "»", "›", ">", "/", "::"}
BOILERPLATE = re.compile(
    r"cookie policy|accept (?:all )?cookies|we use cookies|enable javascript|javascript is (?:disabled|required)|privacy policy|terms of (?:use|service)"
    r"|all rights reserved|sign in to|log in to|subscribe to our|click here|skip to (?:main )?content|lorem ipsum",
    re.I,
)
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", ")", "»", "”", "。", "！", "？", "؟", "।", ",")
# One word in so many is enough of notices to fail a line, and of ends of sentences or clauses to pass it.
NOTICE, SENTENCE = 5, 40
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS, MAX_REPEAT, MIN_KEPT = 50, 50, 0.5
# A longer text has ever fewer new words, so the share of different ones is taken over as many words at most.
SPAN = 2000


def cases(line: str) -> tuple[int, int]:
    """Capitals and letters of the whole line."""
    if line.isascii():
        raw = line.encode()
        capitals = len(raw) - len(raw.translate(None, CAPITALS))
        return capitals, capitals + len(raw) - len(raw.translate(None, CAPITALS.lower()))
    letters = "".join(filter(str.isalpha, line))
    return sum(map(str.isupper, letters)), len(letters)


def kinds(words: list[str]) -> tuple[int, int]:
    """Different words and words, summed over all windows of SPAN words, or of the line if it is shorter."""
    n, span = len(words), min(len(words), SPAN)
    if n == span:
        return len(set(words)), n
    last: dict[str, int] = {}
    first = 0
    for i, w in enumerate(words):
        # Windows in which this word is the first of its kind: they start after its last place, and hold place i.
        first += max(0, min(i, n - span) - max(last.get(w, -1), i - span))
        last[w] = i
    return first, span * (n - span + 1)


def judge(line: str, words: list[str], earlier: set[str]) -> str:
    """The first rule that a line with words fails, or ''."""
    n = len(words)
    bars = sum(w in SEPARATORS for w in words)
    if bars >= 2 and 4 * bars > n:
        return "navigation"
    if SYMBOLS.search(line) and 10 * sum(SYMBOLS.search(w) is not None for w in words) > 3 * n:
        return "symbols"
    if n >= 3:
        if 2 * sum(w.endswith("!!") for w in words) > n:
            return "shouting"
        capitals, letters = cases(line)
        if 10 * capitals > 7 * letters:
            return "shouting"
    if n >= 10:
        different, of = kinds(words)
        if 5 * different < of or 2 * sum(map(str.__eq__, words, words[1:])) > n:
            return "repetition"
    notices = [m[0] for m in BOILERPLATE.finditer(line)]
    if notices and NOTICE * sum(m.count(" ") + 1 for m in notices) >= n:
        return "boilerplate"
    if line in earlier:
        return "duplicate"
    if not words[-1].endswith(ENDS) and SENTENCE * sum(w.endswith(ENDS) for w in words) < n:
        return "punctuation"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, c in Counter(windows).items() if c > 1}
    count, upto = 0, 0
    for i, w in enumerate(windows):
        if w in often:
            count += i + 3 - max(upto, i)
            upto = i + 3
    return count


def assess(text: str) -> dict:
    """All counts and verdicts of one text."""
    words_of = WORDS.findall
    n_words = chars = kept_chars = dup = kept_lines = lines = 0
    all_words: list[str] = []
    earlier: set[str] = set()
    failed: Counter = Counter()
    kept_text = []
    for line in text.split("\n"):
        words = words_of(line)
        if not words:
            continue
        lines += 1
        size = sum(map(len, words))
        chars += size
        all_words += words
        why = judge(line, words, earlier)
        if line in earlier:
            dup += 1
        earlier.add(line)
        if why:
            failed[why] += 1
        else:
            kept_lines += 1
            kept_chars += size
            kept_text.append(line)
    n_words = len(all_words)
    repeat = repeated_words(all_words)
    base_failed = n_words < MIN_WORDS or 100 * repeat > MAX_REPEAT * n_words
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": len(SYMBOLS.findall(text)), "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": base_failed,
        "kept": not base_failed and kept_chars >= MIN_KEPT * chars, "n_lines": lines, "n_kept_lines": kept_lines, "kept_chars": kept_chars, "failed_rules": ",".join(sorted(failed)), "clean_text": "\n".join(kept_text),
    }


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines", "kept_chars", "failed_rules")
SCHEMA = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_kept_lines long, kept_chars long, failed_rules string"
KINDS = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 3 + [pa.string()]


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Counts and verdict for each document; ``with_text`` adds what is left of the text as ``clean_text``."""
    names, kinds = (NAMES + ("clean_text",), [*KINDS, pa.string()]) if with_text else (NAMES, KINDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            found = [assess(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in zip(names, kinds))], ["id", *names])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA + (", clean_text string" if with_text else ""))


def op10_line_rules(spark, sf_dir: str) -> DataFrame:
    """Every document under the line rules."""
    return clean_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
