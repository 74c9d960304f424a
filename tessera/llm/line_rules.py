"""Line-first cleaning; DataFrame operations only.

Every line is judged alone.  Lines that fail are removed, and a document that
loses too much of its text by it is rejected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\f\r"
#: What a line of boilerplate says, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "privacy policy",
    "terms of use",
    "terms of service",
    "cookie policy",
    "accept cookies",
    "enable javascript",
    "javascript is disabled",
    "click here",
    "sign up for our newsletter",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "cookies akzeptieren",
    "tous droits réservés",
    "politique de confidentialité",
    "accepter les cookies",
    "todos los derechos reservados",
    "política de privacidad",
    "aceptar cookies",
)
#: Symbols that words of prose don't hold; a line fails with more than one for every four words.
SYMBOLS = "#*$%&|<>"
#: Marks that set apart the entries of a menu; a line with this many fails.
BARS, MOST_BARS = "|»›·•", 3
#: A line with so many links, or with one and so few words, fails.
LINK, MOST_LINKS, LINK_WORDS = "://", 2, 3
#: Marks that end a sentence or what is quoted; a line of so many words has to end with one.
ENDS, FULL_LINE = ".!?…:;,\"'”’»)]", 20
#: A line with so many exclamation marks, and one for every two words, fails.
SHOUTS = 4
#: A line of so many characters has to have a mark that ends or divides a sentence.
LONG_LINE = 400
#: A document is rejected if lines with more than this part of its characters fail.
MOST_LOST = 0.5


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def without(text: Column, chars: str) -> Column:
    """text without these characters, each one removed by a plain search."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(without(text, chars))


def count_of_text(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))


def split_words(text: Column) -> Column:
    """Words between white space."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def line_fails(line: Column, doc: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line that has a word.

    Spaces count the words.  A rule is looked at only in documents that have
    what it looks for.
    """
    words = count_of(line, " ") + 1
    symbols = doc["has_symbols"] & (count_of(line, SYMBOLS) * 4 > words)
    menu = doc["has_bars"] & (count_of(line, BARS) >= MOST_BARS)
    links = doc["has_links"] & let(count_of_text(line, LINK), lambda n: (n >= MOST_LINKS) | ((n >= 1) & (words <= LINK_WORDS)))
    unfinished = (words >= FULL_LINE) & ~F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)).isin(*ENDS)
    shouts = doc["has_shouts"] & let(count_of(line, "!"), lambda n: (n >= SHOUTS) & (n * 2 >= words))
    endless = (F.length(line) >= LONG_LINE) & ~line.rlike("[.,;:!?…]")
    boilerplate = doc["has_phrase"] & has_phrase(line)
    return symbols | menu | links | shouts | unfinished | endless | boilerplate


def has_phrase(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        out = F.lit(False)
        for phrase in BOILERPLATE:
            out = out | F.contains(low, F.lit(phrase))
        return out

    return let(F.lower(text), any_of)


def repeated(hashes: Column, width: int) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twin = lambda k, d: F.get(s, k + d)["h"] == s[k]["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(twin(k, -1), F.lit(False)) | F.coalesce(twin(k, 1), F.lit(False)))
        places = F.array_sort(F.transform(hit, lambda k: s[k]["i"]))
        return let(places, lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda acc, k: acc + F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - p[k], F.lit(width)))))

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def _verdict(text: Column, width: int) -> Column:
    """All of judge's columns as one struct: a filter on one of them that Spark moves down works it out once more, and no part of it for each word."""
    full = lambda x: x.rlike(f"[^{SPACE}]")
    chars = lambda lines: F.length(F.array_join(lines, ""))

    def windows(words: Column) -> Column:
        hash_ = lambda w, i: F.xxhash64(w, *[F.get(words, i + d) for d in range(1, width)])
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(0))), hash_)

    def result(words: Column, lines: Column, doc: Column, lines_full: Column, failing: Column) -> Column:
        lost = F.coalesce(chars(failing) / F.nullif(chars(lines_full), F.lit(0)), F.lit(0.0))
        left = F.filter(lines, lambda x: ~full(x) | ~line_fails(x, doc))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            doc["n_symbols"].cast("long").alias("n_symbols"),
            (F.size(lines_full) - F.size(F.array_distinct(lines_full))).cast("long").alias("n_dup_lines"),
            F.when(F.size(words) < width, F.lit(0)).otherwise(let(windows(words), lambda h: repeated(h, width))).cast("long").alias("n_repeat_words"),
            lost.alias("lost"),
            F.when(F.size(failing) > 0, F.array_join(left, "\n")).alias("changed_text"),
        )

    doc = lambda n: F.struct(n.alias("n_symbols"), (n > 0).alias("has_symbols"), F.contains(text, F.lit("!")).alias("has_shouts"), (count_of(text, BARS) >= MOST_BARS).alias("has_bars"), F.contains(text, F.lit(LINK)).alias("has_links"), has_phrase(text).alias("has_phrase"))
    known = lambda words, d, lines: let(F.filter(lines, full), lambda f: let(F.filter(f, lambda x: line_fails(x, d)), lambda failing: result(words, lines, d, f, failing)))
    return let(split_words(text), lambda words: let(let(count_of(text, SYMBOLS), doc), lambda d: let(F.split(text, "\n"), lambda lines: known(words, d, lines))))


def judge(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts, the verdict and the cleaned text.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, kept (boolean), lost double (part of the characters in lines
    with words that failing lines hold), clean_text string.  A null text counts
    as empty: no words, so base_failed.  Rows are judged alone, so repeated rows
    and ties play no part; an empty table gives no rows.
    """
    rows = documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.select("doc_id", "text", _verdict(F.col("text"), width).alias("v"))
    out = out.select("doc_id", *[F.col("v")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost")], F.coalesce(F.col("v")["changed_text"], F.col("text")).alias("clean_text"))
    out = out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= MOST_LOST))
