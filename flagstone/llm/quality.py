"""Line-first cleaning: drop failing lines, then reject documents that lost too much text.

Native DataFrame functions only; one scan, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagstone.llm.common import BLANKS, WORD, bind, free_prefix

# Fixed values of the line rules.
SYMBOLS = "#*$%&|<>"
MENU_WORDS = ["home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "next", "previous",
              "back to top", "read more", "skip to content", "contact us", "about us", "site map"]
BOILERPLATE = ["all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "subscribe to our newsletter", "enable javascript", "lorem ipsum", "click here", "powered by"]


def word_list(text: Column) -> Column:
    """Words of a text; null counts as no text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def word_chars(text: Column) -> Column:
    """Code points of a text that are not blank."""
    return F.length(F.translate(text, BLANKS, ""))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside windows of ``size`` words that occur twice or more in the list, each word once.

    Windows are compared by a 64-bit hash. Only a list in which two windows agree is sorted.
    """

    def covered(starts: Column) -> Column:
        first = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            starts,
            first,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i + size - a["end"])).alias("n"), (i + size).alias("end")),
            lambda a: a["n"],
        )

    def starts(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.get(a, b[0])["h"] == F.get(a, b[1])["h"]
        twice = lambda s: F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.coalesce(same(s, (k, k - 1)), F.lit(False)) | F.coalesce(same(s, (k, k + 1)), F.lit(False)),
        )
        return bind(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda k: F.get(s, k)["i"])))

    def hashes(w: Column) -> Column:
        window = lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), window)

    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(starts(h)))
    return bind(words, lambda w: F.when(F.size(w) < size, 0).otherwise(bind(hashes(w), count)))


def line_fails(line: Column, max_symbols: float) -> Column:
    """True for a line that a rule rejects; blank lines pass.

    Punctuation: no letter at all, or symbols above a share of its characters, or three or more
    exclamation marks where no word has a lower-case letter. Navigation: four or more pieces of at
    most four words between bars, or a menu word alone. Boilerplate: a stock phrase of web pages.
    """
    chars = F.length(line)
    symbols = chars - F.length(F.translate(line, SYMBOLS + "{}[]~^=_\\", ""))
    shouted = (F.upper(line) == line) & (F.length(line) - F.length(F.translate(line, "!", "")) >= 3)
    no_letter = ~line.rlike(r"\p{L}")
    bars = r"^(\s*[^\s|»›·]+(\s+[^\s|»›·]+){0,3}\s*[|»›·]){3,}"

    def stock(low: Column) -> Column:
        found = F.trim(low).isin(MENU_WORDS)
        for p in BOILERPLATE:
            found = found | F.contains(low, F.lit(p))
        return found

    failed = no_letter | (symbols > max_symbols * chars) | shouted | line.rlike(bars) | bind(F.lower(line), stock)
    return line.rlike(WORD) & failed


def judge(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    min_words: int = 10,
    max_repeated: int = 20,
    max_symbols: float = 0.15,
    max_lost: float = 0.5,
) -> DataFrame:
    """Columns ``keep`` (all, if None) with the measures, the verdict and the cleaned text, as struct ``quality``.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept
    (boolean), lost_chars (long), clean_text (string). ``kept`` is false if ``base_failed`` (fewer
    than ``min_words`` words, or above ``max_repeated`` percent of them in repeated windows of five
    words), or if failing lines hold more than ``max_lost`` of all characters in words.

    A null text counts as empty: no words, base_failed, clean_text ''. Repeated rows and tied ids
    are judged one by one. A column named quality is replaced, other columns are neither read nor
    changed, whatever their names.
    """
    lines = bind(
        F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1),
        lambda ls: F.struct(
            F.filter(ls, lambda x: x.rlike(WORD)).alias("full"),
            F.filter(ls, lambda x: ~line_fails(x, max_symbols)).alias("good"),
        ),
    )
    own = free_prefix(docs)
    got = docs.select(
        *[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() != "quality"],
        F.coalesce(F.col(text), F.lit("")).alias(own + "text"),
        word_list(F.col(text)).alias(own + "words"),
        lines.alias(own + "lines"),
    )
    body, words = F.col(own + "text"), F.col(own + "words")
    full, good = F.col(own + "lines.full"), F.col(own + "lines.good")
    measured = got.withColumn(
        own + "m",
        F.struct(
            F.size(words).cast("long").alias("n_words"),
            word_chars(body).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("n_dup_lines"),
            repeated_words(words).cast("long").alias("n_repeat_words"),
            F.array_join(good, "\n").alias("clean_text"),
        ),
    ).drop(own + "text", own + "words", own + "lines")
    m = lambda c: F.col(f"{own}m.{c}")
    base = (m("n_words") < min_words) | (100 * m("n_repeat_words") > max_repeated * m("n_words"))
    lost = (m("word_chars") - word_chars(m("clean_text"))).cast("long")
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return measured.withColumn(
        "quality",
        F.struct(
            *[m(c).alias(c) for c in fields],
            base.alias("base_failed"),
            (~base & (lost <= max_lost * m("word_chars"))).alias("kept"),
            lost.alias("lost_chars"),
            m("clean_text").alias("clean_text"),
        ),
    ).drop(own + "m")
