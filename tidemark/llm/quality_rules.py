"""Quality rules by distribution divergence, in DataFrame expressions only.

Every text gets two histograms: its characters by class, and how often it uses each common word of
its language beside all other words. Both are held against the language's reference by
Jensen-Shannon distance (base 2, so 0 to 1). References are the summed histograms of all documents of
that language, one row a language; languages beyond the four word lists share one reference over all
lists. A histogram of a text below the minimum length means little, and its rule passes such a text.

Plain counts come with the verdict: length in words, characters in words, symbols, repeated lines and
words inside repeated word windows. A text fails them when it has too few words or too many repeats.

Scale: one narrow scan for the references (a row a language leaves each task, at most five rows are
broadcast) and one for the verdict; no text is shuffled. Work on a text is array arithmetic of order
n log n inside its own row, so one very long text costs in proportion.

Defined results: null and empty texts have zero counts, fail the base rules and are not kept; a null
or unknown language uses the shared reference; repeated rows are judged each on their own; an empty
table gives an empty result; further columns are carried when named in ``carry``, and the names of
the result's own columns win over clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import settled

BLANK = r"[\x20\x09-\x0D]+"
#: Frequent function words of the four languages.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "on", "by", "this"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"),
}
#: The list of a language that has none of its own.
ANY = tuple(sorted({w for words in COMMON_WORDS.values() for w in words}))
#: Character classes as the inside of a regular expression's brackets; the rest is counted together.
CHAR_CLASSES = (r"\p{Lu}", r"0-9", r"\x20\x09-\x0D", r".,;:!?'\"()\-", r"#*$%&|<>")
SYMBOLS = CHAR_CLASSES.index(r"#*$%&|<>")
BLANKS = CHAR_CLASSES.index(r"\x20\x09-\x0D")


def text_words(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space; none for a null text."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(body) == 0, F.array().cast("array<string>")).otherwise(F.split(body, BLANK))


def _class_counts(text: Column) -> Column:
    """Code points of text by character class, what no class takes last."""
    counts = [F.length(F.regexp_replace(text, f"[^{c}]+", "")) for c in CHAR_CLASSES]
    return F.array(*counts)


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit("other"))


def _histograms(documents: DataFrame) -> DataFrame:
    """Adds _words, _lang, _chars and _common (counts by bin, the rest in the last bin of each)."""
    base = documents.withColumns({"_text": F.coalesce(F.col("text"), F.lit("")), "_lang": _language(F.col("lang"))})
    base = base.withColumns({"_words": text_words(F.col("_text")), "_classes": _class_counts(F.col("_text"))})
    known = F.filter("_words", lambda w: w.isin(*ANY))
    base = base.withColumns({"_known": known, "_chars": F.concat("_classes", F.array(F.length("_text") - F.aggregate("_classes", F.lit(0), lambda a, x: a + x)))})
    lists = F.array(*map(F.lit, ANY))
    for lang, words in COMMON_WORDS.items():
        lists = F.when(F.col("_lang") == lang, F.array(*map(F.lit, words))).otherwise(lists)
    # every known word between two spaces of its own, so that what its removal frees tells its uses
    base = base.withColumn("_joined", F.concat(F.lit(" "), F.array_join("_known", "  "), F.lit(" ")))
    freed = lambda w: F.octet_length("_joined") - F.octet_length(F.replace(F.col("_joined"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
    base = base.withColumn("_uses", F.transform(lists, lambda w: (freed(w) / (F.octet_length(w) + 2)).cast("int")))
    rest = F.size("_words") - F.aggregate("_uses", F.lit(0), lambda a, x: a + x)
    return base.withColumn("_common", F.concat("_uses", F.array(rest))).drop("_known", "_joined", "_classes", "_uses")


def language_references(documents: DataFrame) -> DataFrame:
    """One row a language: lang, chars and common as summed histograms of all its documents."""
    h = _histograms(documents.select("text", "lang"))
    widths = {"_chars": len(CHAR_CLASSES) + 1, "_common": len(ANY) + 1}
    sums = [F.sum(F.get(c, F.lit(i)).cast("long")).alias(f"{c}{i}") for c, n in widths.items() for i in range(n)]
    rows = h.groupBy("_lang").agg(*sums)
    array = lambda c: F.array(*[F.coalesce(F.col(f"{c}{i}"), F.lit(0).cast("long")) for i in range(widths[c])])
    return rows.select(F.col("_lang").alias("lang"), array("_chars").alias("chars"), array("_common").alias("common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two distributions given as arrays of shares; 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        m = (a + b) / 2
        return (term(a, m) + term(b, m)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(p, q, part), F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _paired(column: str, step: int):
    return lambda x, i: F.xxhash64(x, F.get(column, i + step))


def window_names(df: DataFrame, column: str, size: int) -> DataFrame:
    """Replace an array of 64-bit symbol names by the names of its windows of that size.

    Names double their reach: a pair of names a distance apart is hashed to the name of both, and two
    overlapping names of the largest power of two below the size make up the rest.
    """
    reach = 1
    while reach < size:
        step = min(reach, size - reach)
        pairs = F.transform(column, _paired(column, step))
        kept = F.greatest(F.size(column) - step, F.lit(0))
        df = df.withColumn(column, F.when(F.size(column) > step, F.slice(pairs, F.lit(1), kept)).otherwise(F.array().cast("array<bigint>")))
        reach += step
    return df


def _repeats(df: DataFrame, size: int) -> DataFrame:
    """Adds n_repeat_words: words in windows of _words found twice or more in the text.

    Equal windows meet by sorting (64-bit hash, start), only in texts that have any; what they cover
    is the gaps between the sorted starts, each at most one window long.
    """
    df = window_names(df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w))), "_hashes", size)
    keyed = F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_keyed", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), keyed))
    same = lambda x, k: F.coalesce(F.get("_keyed", k)["h"] == x["h"], F.lit(False))
    starts = F.filter(F.transform("_keyed", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull())
    df = df.withColumn("_starts", F.sort_array(starts))
    gaps = F.zip_with("_starts", F.slice("_starts", 2, F.greatest(F.size("_starts"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(size)))
    covered = F.aggregate(gaps, F.lit(0), lambda s, x: s + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_hashes", "_keyed", "_starts")


def quality_verdicts(
    documents: DataFrame,
    *,
    references: DataFrame | None = None,
    carry: tuple[str, ...] = ("doc_id",),
    min_words: int = 20,
    max_repeat_percent: int = 30,
    window: int = 8,
    min_chars_histogram: int = 200,
    min_words_histogram: int = 100,
    max_char_distance: float = 0.3,
    max_word_distance: float = 0.28,
) -> DataFrame:
    """The carried columns, the counts, both distances, base_failed and kept."""
    if references is None:
        references = language_references(documents)
    refs = references.select(F.col("lang").alias("_lang"), _shares(F.col("chars")).alias("_ref_chars"), _shares(F.col("common")).alias("_ref_common"))
    h = _repeats(_histograms(documents), window)
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    h = h.withColumns({"_lines": lines, "n_words": F.size("_words").cast("long")})
    h = h.withColumns(
        {
            "word_chars": (F.length("_text") - F.get("_chars", F.lit(BLANKS))).cast("long"),
            "n_symbols": F.get("_chars", F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    h = h.join(F.broadcast(refs), "_lang", "left")
    fill = F.slice("_ref_common", 1, F.size("_common"))
    h = h.withColumns({"char_distance": js_distance(_shares(F.col("_chars").cast("array<long>")), F.col("_ref_chars")), "word_distance": js_distance(_shares(F.col("_common").cast("array<long>")), fill)})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    far = (F.length("_text") >= min_chars_histogram) & (F.col("char_distance") > max_char_distance)
    odd = (F.col("n_words") >= min_words_histogram) & (F.col("word_distance") > max_word_distance)
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance")
    h = h.withColumns({"base_failed": failed, "_off": F.coalesce(far | odd, F.lit(False))})
    h = h.withColumn("_kept", ~F.col("base_failed") & ~F.col("_off"))
    names = [*own, "base_failed", "kept"]
    return h.select(*[c for c in carry if c not in names], *[settled(F.col("_kept" if c == "kept" else c)).alias(c) for c in names])
