"""Line-first quality rules, as expressions over one text: no shuffle, no Python.

Lines that fail a rule on punctuation, navigation or boilerplate are removed first; a document that loses too much of
its text that way, or that fails a base rule on length or repetition, is rejected.

Defined results: a null or empty text has no words and fails the base rule; a text of any length is judged whole, in one
row; an empty table gives an empty table; repeated rows are judged alike; other columns are carried or ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, word_count, words

#: A document needs so many words.
MIN_WORDS = 50
#: Per cent of words in 3-word windows found twice or more.
MAX_REPEATED = 50
#: Per cent of a document's words that its removed lines may hold.
MAX_LOST = 50
#: A line shorter than this without an end mark is a heading, menu entry or fragment.
SHORT_LINE = 8
#: Per cent of a line's words that may carry a run of symbols or two exclamation marks.
MAX_NOISY = 30

#: Words and marks that the rules know.
END_MARK = r"[.!?:;…。！？][\x22\x27“”’»)\]]*[\x20\x09-\x0D]*\z"
INNER_MARK = r"[.,;:!?]"
MENU = r"[\x20\x09](?:\||>|»|•)[\x20\x09]"
NOISY_WORD = r"(?:[#*$%&|<>]{2,}|!!+)(?:[\x20\x09-\x0D]|\z)"
BOILERPLATE = r"(?i)^[\x20\x09]*(?:all rights reserved|licensed under|released under the|this work is licensed|copyright (?:\(c\)|©|[0-9])|terms of (?:use|service)|privacy policy|cookie policy|we use cookies|sign in|log in|click here|subscribe to|share this|skip to (?:main )?content|lorem ipsum)"


def line_fails(line: Column, count: Column) -> Column:
    """Whether a line of ``count`` words, one at least, is removed."""
    no_end = ~line.rlike(END_MARK) & ((count < SHORT_LINE) | ~line.rlike(INNER_MARK))
    menu = F.regexp_count(line, F.lit(MENU)) * 3 >= count
    noisy = F.regexp_count(line, F.lit(NOISY_WORD)) * 100 > count * MAX_NOISY
    return no_end | menu | noisy | line.rlike(BOILERPLATE)


def judged_lines(body: Column) -> Column:
    """``line``, its words ``n`` and whether it is removed, ``bad``, for each line of a text."""
    counted = F.transform(F.split(body, "\n"), lambda x: F.struct(x.alias("line"), word_count(x).alias("n")))
    return F.transform(counted, lambda c: F.struct(c["line"].alias("line"), c["n"].alias("n"), ((c["n"] > 0) & line_fails(c["line"], c["n"])).alias("bad")))


def window_hashes(tokens: Column) -> Column:
    """A hash of each 3-word window, in text order."""
    n = F.size(tokens)
    hashes = F.transform(tokens, lambda x, i: F.xxhash64(x, F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.when(n >= 3, F.slice(hashes, F.lit(1), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<long>"))


def covered_words(pairs: Column) -> Column:
    """From the windows as sorted (hash, place) pairs, a stored column: the words that windows with an equal neighbour cover."""
    hash_at = lambda k: F.get(pairs, k)["h"]
    repeated = F.filter(pairs, lambda p, k: F.coalesce(p["h"] == hash_at(k - 1), F.lit(False)) | F.coalesce(p["h"] == hash_at(k + 1), F.lit(False)))
    spots = F.sort_array(F.transform(repeated, lambda p: p["i"]))
    return F.aggregate(
        spots, F.struct(F.lit(0).alias("sum"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["sum"] + F.least(F.lit(3), i - s["last"])).alias("sum"), i.alias("last")),
    )["sum"]


def score_rules(docs: DataFrame, *, text: str = "text", row_id: str = "doc_id", keep: tuple[str, ...] = (), cleaned: str | None = None) -> DataFrame:
    """``row_id``, the base measures, ``lost_words``, ``base_failed`` and ``kept`` of each row; ``keep`` names columns to carry along.

    ``cleaned`` names a column for the text without its failing lines. Each step keeps only what later ones need, so a
    row holds one array of its words or lines at a time.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    carried = ["_id", *[f"_keep_{c}" for c in keep], "_t"]
    rows = docs.select(F.col(row_id).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], body.alias("_t"))
    rows = rows.select(*carried, words(F.col("_t")).alias("_tokens"))
    rows = rows.select(*carried, F.size("_tokens").cast("long").alias("n_words"), window_hashes(F.col("_tokens")).alias("_hashes"))
    pairs = F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*carried, "n_words", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), pairs).alias("_pairs"))
    rows = rows.select(*carried, "n_words", F.coalesce(covered_words(F.col("_pairs")), F.lit(0)).cast("long").alias("n_repeat_words"), judged_lines(F.col("_t")).alias("_lines"))
    known = F.filter("_lines", lambda x: x["n"] > 0)["line"]
    measures = {
        "word_chars": F.length(F.translate("_t", BLANKS, "")).cast("long"),
        "n_symbols": F.regexp_count(F.col("_t"), F.lit("[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(known) - F.size(F.array_distinct(known))).cast("long"),
        "lost_words": F.aggregate("_lines", F.lit(0).cast("long"), lambda s, x: s + F.when(x["bad"], x["n"]).otherwise(F.lit(0).cast("long"))),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED),
    }
    rows = rows.select(
        *carried[:-1], "n_words", "n_repeat_words", *[c.alias(n) for n, c in measures.items()],
        *([F.array_join(F.filter("_lines", lambda x: ~x["bad"])["line"], "\n").alias("_cleaned")] if cleaned else []),
    )
    out = [
        F.col("_id").alias(row_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_words", "base_failed",
        (~F.col("base_failed") & (F.col("lost_words") * 100 <= F.col("n_words") * MAX_LOST)).alias("kept"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep], *([F.col("_cleaned").alias(cleaned)] if cleaned else []),
    ]
    # a filter on the result would be moved below, where each use of a word array computes it anew; it can't pass this
    return rows.select(F.explode(F.array(F.struct(*out))).alias("_scored")).select("_scored.*")


def clean_text(text: Column) -> Column:
    """The text without its failing lines; lines without a word stay."""
    return F.array_join(F.filter(judged_lines(F.coalesce(text, F.lit(""))), lambda x: ~x["bad"])["line"], "\n")


def keep_good(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns; ``text`` is without its failing lines."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col(f"`{text}`").alias("body"))
    good = score_rules(whole, text="body", row_id="row", cleaned="cleaned").where("kept")
    return good.select(*[(F.col("cleaned") if c == text else F.col(f"row.c{k}")).alias(c) for k, c in enumerate(docs.columns)])
