"""Line-first quality rules with DataFrame functions only.

Every line is judged alone by punctuation, navigation (separators, links), symbol, shouting and boilerplate rules; lines that
fail are removed, and so is a line that repeats an earlier one; a document that loses too much of its text this way is rejected. Document rules (base) stand beside them: too few words,
or too many words inside repeated five-word windows.

Defined results: a null text has no words, no lines and fails base; an empty or white-space text likewise; lines without a
word are neither judged nor counted; other columns are left alone; rows that repeat are judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import WORD, let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Signs that part the links of a navigation line.
SEPARATORS = "|»›•·→"
LINK = r"(?:https?://|www\.)[^\x20\x09-\x0D]+"
#: Phrases of page furniture and notices, lower case, in English, German, French and Spanish; each begins a word.
BOILERPLATE = r"(?:^|[ \t(])(?:" + "|".join([
    "all rights reserved", "cookie policy", "privacy policy", "terms of (?:use|service)", "enable javascript", "subscribe to our newsletter",
    "click here to", "powered by", "share on (?:facebook|twitter)", "(?:licensed|released) under",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "newsletter abonnieren", "hier klicken", "javascript aktivieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "abonnez-vous", "cliquez ici", "activer javascript",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "suscríbete", "haga clic aquí", "activar javascript",
]) + ")"
END = list(".!?:;…。！？»”\"')]")


def chars_less(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def line_fails(line: Column, symbols_percent: int = 5, separators: int = 2, shout_percent: int = 40, open_words: int = 4, prose_words: int = 15, link_percent: int = 50) -> Column:
    """True where a line (with a word) fails a rule; percentages are of its characters, white space aside.

    Punctuation: a line of open_words words or more must end a sentence, unless it has prose_words: then it is prose that was
    cut. Navigation: separators of links, or links that are more than link_percent of the line. Besides these: symbols,
    shouting and boilerplate.
    """
    least = lambda n: line.rlike(rf"^[\x20\x09-\x0D]*(?:{WORD}[\x20\x09-\x0D]+){{{n - 1}}}{HAS_WORD}")
    unfinished = least(open_words) & ~least(prose_words) & ~F.substring(F.rtrim(line, F.lit(SPACES)), -1, 1).isin(END)
    navigation = F.regexp_count(line, F.lit(f"[{SEPARATORS}]")) >= separators

    def by_share(solid: Column) -> Column:
        symbols = F.regexp_count(line, F.lit("[#*$%&<>]")) * 100 > solid * symbols_percent
        shouting = (solid >= 20) & (F.regexp_count(line, F.lit(r"\p{Lu}")) * 100 > solid * shout_percent)
        links = (line.contains("http") | line.contains("www.")) & (chars_less(F.regexp_replace(line, LINK, ""), SPACES) * 100 < solid * (100 - link_percent))
        return symbols | shouting | links

    return unfinished | navigation | let(chars_less(line, SPACES), by_share) | F.lower(line).rlike(BOILERPLATE)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(HAS_WORD))


def repeated_window_words(words: Column, k: int = 5) -> Column:
    """Words inside k-word windows that occur twice or more in the text, first occurrences included.

    Windows are told apart by chained 64-bit hashes; positions of repeated ones come from one sort, so the work is n log n.
    """

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))

        def covered(h: Column) -> Column:
            pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

            def of_sorted(s: Column) -> Column:
                twice = lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
                at = F.array_sort(F.transform(F.filter(s, twice), lambda x: x["i"]))
                return let(at, lambda a: F.aggregate(F.transform(a, lambda p, i: F.least(F.lit(k), F.coalesce(F.get(a, i + 1) - p, F.lit(k)))), F.lit(0), lambda acc, x: acc + x))

            return F.when(F.size(F.array_distinct(h)) < F.size(h), let(pairs, of_sorted)).otherwise(F.lit(0))

        return F.when(F.size(w) > k, let(windows, covered)).otherwise(F.lit(0))

    return let(words, counted)


def judge(docs: DataFrame, least_kept_percent: int = 50, least_words: int = 10, repeat_percent: int = 20, text: str = "text") -> DataFrame:
    """docs with counts, `base_failed`, `text_clean` (its lines that pass) and `kept`."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("n_words", F.regexp_count(t, F.lit(WORD)).cast("long"))
    d = d.withColumn("word_chars", chars_less(t, SPACES).cast("long")).withColumn("n_symbols", (F.length(t) - chars_less(t, SYMBOLS)).cast("long"))
    lines = let(lines_with_words(t), lambda ls: F.struct((F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup"), F.array_join(F.filter(F.array_distinct(ls), lambda line: ~line_fails(line)), "\n").alias("clean")))
    found = "_lines" + "_" * max(map(len, docs.columns))  # longer than any column's name
    d = d.withColumn(found, lines).withColumn("n_dup_lines", F.col(found)["dup"]).withColumn("text_clean", F.col(found)["clean"]).drop(found)
    d = d.withColumn("n_repeat_words", repeated_window_words(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))).cast("long"))
    d = d.withColumn("base_failed", (F.col("n_words") < least_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * repeat_percent))
    d = d.withColumn("clean_chars", chars_less(F.col("text_clean"), SPACES).cast("long"))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("clean_chars") * 100 >= F.col("word_chars") * least_kept_percent))
