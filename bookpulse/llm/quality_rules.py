"""Quality rules: a table of thresholds, compiled into one projection of ratios.

A rule names two counts of a text and the least and greatest share, in thousandths, that the
first may be of the second. The table is compiled into Spark expressions: counts are columns,
every rule is a comparison of whole numbers, and the verdict is their conjunction. Nothing but
built-in functions looks at a text, and nothing is shuffled.

Words are maximal runs without blanks and control white space (0x20, 0x09 to 0x0D); lines are
split at line feeds, and only those that hold a word count.

Rows: a null or empty text has no words and fails the least length; repeated rows are judged
one by one and alike; a count equal to a threshold passes; an empty table gives no rows; very
long texts are judged whole (their words are held in one row); other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import own_columns

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Base limits: fewer words than this, or more than this many of 100 words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Frequent words of the languages read. They count in lower case or with a capital
#: first letter, where no punctuation is attached.
STOP_WORDS = tuple(sorted(set((
    "a an and are as at be by for from had has have he her his i in is it its not of on or she that the they this "
    "to was we were which will with you "
    "als am an auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht sich sie und von war "
    "zu zum "
    "au aux avec ce dans de des du elle en est et il la le les mais ne ou par pas plus pour que qui sur un une "
    "al como con de del el en es la las lo los más no o para pero por que se si su sus un una y"
).split())))


class Rule(NamedTuple):
    """``low <= 1000 * part / whole <= high``; None is no limit."""

    name: str
    part: str
    whole: str
    low: int | None
    high: int | None


#: Counts per text and their shares in thousandths. Figures on labelled rows are in the README.
RULES = (
    Rule("word_length", "word_chars", "n_words", 3000, 10000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, 800),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 300),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 300),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 900),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words in windows of three words that stand at two or more places of the text."""
    windows = F.slice(F.transform(words, lambda w, i: F.struct(
        F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("text"), i.alias("at"),
    )), 1, F.size(words) - 2)

    def places(s: Column) -> Column:  # sorted, so equal windows are next to each other
        again = F.filter(s, lambda x, k: (x["text"] == F.get(s, k - 1)["text"]) | (x["text"] == F.get(s, k + 1)["text"]))
        return F.transform(again, lambda x: x["at"])

    def covered(at: Column) -> Column:
        one, two = F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)
        return F.size(F.array_union(F.array_union(at, one), two))

    exact = let(F.sort_array(windows), lambda s: let(places(s), covered))
    # Hashes rule out repeats in most texts; where some agree, the words themselves decide.
    hashes = F.slice(
        F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, F.size(words) - 2
    )
    several = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < 4, 0).when(several, F.coalesce(exact, F.lit(0))).otherwise(0)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of each text that rules may name, as long columns."""
    none = F.array().cast("array<string>")
    rows = own_columns(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    split = rows.select(
        "doc_id", "text", F.trim("text", F.lit(SPACE)).alias("bare"),
    ).select(
        "doc_id", "text",
        F.when(F.col("bare") == "", none).otherwise(F.split("bare", r"[\x20\x09-\x0D]+")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(SPACE)) != "").alias("lines"),
    )
    words, lines = F.col("words"), F.col("lines")
    stop = F.filter(words, lambda w: w.isin(*STOP_WORDS, *map(str.capitalize, STOP_WORDS)))
    bare_lines = F.transform(lines, lambda x: F.trim(x, F.lit(SPACE)))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.size(F.split("text", f"[{SYMBOLS}]")) - 1,
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeated(words),
        "n_stop_words": F.size(stop),
        "n_lines": F.size(lines),
        "n_ellipsis_lines": F.size(F.filter(bare_lines, lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter(bare_lines, lambda x: x.startswith("-") | x.startswith("*") | x.startswith("•"))),
    }
    return split.select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()])


def broken(rule: Rule) -> Column:
    """True if the counts of a row lie outside a rule; a text without the whole breaks none."""
    part, whole, sides = F.col(rule.part) * 1000, F.col(rule.whole), [F.lit(False)]
    if rule.low is not None:
        sides.append(part < whole * rule.low)
    if rule.high is not None:
        sides.append(part > whole * rule.high)
    return reduce(Column.__or__, sides)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, least_words: int = LEAST_WORDS,
          most_repeated: int = MOST_REPEATED) -> DataFrame:
    """Counts, base_failed, failed_rules (names, in the table's order) and kept of every row."""
    base = (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * most_repeated)
    failed = F.filter(
        F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules], F.lit(None).cast("string")), lambda x: x.isNotNull()
    )
    found = measures(docs)
    return found.select(
        "*", base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"),
        (~base & ~reduce(Column.__or__, map(broken, rules), F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The verdict of ``judge`` per doc_id, kept documents only."""
    return judge(docs, rules).where("kept").select("doc_id")
