"""Text of filings: markup, headers and sections, names, figures in prose, phrase evidence, weighted terms.

All of it is string and array expressions on a document's own row, but for term weights, which aggregate over documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.valuation import let

#: Words that end company names and say nothing of them, and English words that weigh nothing.
SUFFIXES = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "llc", "lp", "holdings", "holding", "group", "sa", "nv", "ag")
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "with")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def strip_markup(body: Column) -> Column:
    """Readable text of a page: scripts, styles and comments go, block ends become line ends, other tags spaces, runs of blanks one."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)</?(p|div|br|tr|li|h[1-6]|table|ul|ol|section|article)[^>]*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def normalise_code(code: Column) -> Column:
    """An industry code as at least four digits; null unless it is all digits."""
    c = F.btrim(code)
    return F.when(c.rlike("^[0-9]+$"), F.when(F.length(c) < 4, F.lpad(c, 4, "0")).otherwise(c))


def headers(text: Column, names: tuple[str, ...]) -> Column:
    """Places of headers at line starts, in order: array of (name, at, stop). Told from the lengths between and of matches."""
    pattern = "(?im)^[ ]*(?:" + "|".join(names) + r")\b"
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern)
    parts = F.zip_with(F.slice(between, F.lit(1), F.size(matches)), matches, lambda b, m: F.struct(F.length(b).alias("b"), F.lower(F.btrim(m)).alias("m"), F.length(m).alias("n")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,at:int,stop:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        a = s["at"] + p["b"]
        return F.struct((a + p["n"]).alias("at"), F.concat(s["out"], F.array(F.struct(p["m"].alias("name"), a.alias("at"), (a + p["n"]).alias("stop")))).alias("out"))

    return F.aggregate(parts, start, step, lambda s: s["out"])


def contents_runs(found: Column, most_gap: int = 600) -> Column:
    """Which headers belong to a table of contents: three or more in a row, each close behind the one before it."""
    near = lambda i: F.coalesce(F.get(found, i + 1)["at"] - F.get(found, i)["stop"] <= most_gap, F.lit(False))
    return F.transform(found, lambda h, i: (near(i) & near(i + 1)) | (near(i - 1) & near(i)) | (near(i - 2) & near(i - 1)))


def sections(text: Column, names: tuple[str, ...]) -> Column:
    """Sections in canonical order, each from its first header after the one before: array of (name, start, stop, chars)."""
    order = F.array(*map(F.lit, names))
    start = F.struct(F.lit(0).alias("from"), F.array().cast("array<struct<name:string,at:int,stop:int>>").alias("out"))

    def chosen(found: Column) -> Column:
        def step(s: Column, name: Column) -> Column:
            hit = F.get(F.filter(found, lambda h: (h["name"] == name) & (h["at"] >= s["from"])), F.lit(0))
            return F.when(hit.isNotNull(), F.struct(hit["stop"].alias("from"), F.concat(s["out"], F.array(hit)).alias("out"))).otherwise(s)

        return F.aggregate(order, start, step, lambda s: s["out"])

    def measured(kept: Column) -> Column:
        end = lambda i: F.coalesce(F.get(kept, i + 1)["at"], F.length(text))
        return F.transform(kept, lambda h, i: F.struct(h["name"].alias("name"), h["stop"].alias("start"), end(i).alias("stop"), (end(i) - h["stop"]).alias("chars")))

    # headers are searched once a text, not once a name and section
    return let(let(headers(text, names), chosen), measured)


def covered_share(parts: Column, text: Column) -> Column:
    return F.when(F.length(text) > 0, F.aggregate(parts, F.lit(0), lambda s, p: s + p["chars"]) / F.length(text))


def deglued(text: Column) -> Column:
    """A space where a small letter meets a capital that begins a word."""
    return F.regexp_replace(text, r"([a-z])([A-Z][a-z])", "$1 $2")


def name_words(name: Column) -> Column:
    """Lower-case words of a name without its punctuation."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^a-z0-9]+", " "), " "), lambda w: w != "")


def name_key(name: Column) -> Column:
    """Words of a name without those that end company names."""
    return F.array_join(F.filter(name_words(name), lambda w: ~w.isin(*SUFFIXES)), " ")


def name_variants(name: Column) -> Column:
    """The whole name, without its suffix words, and its first word alone when long enough; the longest first."""
    whole, key = F.array_join(name_words(name), " "), name_key(name)
    first = F.get(F.split(key, " "), F.lit(0))
    every = F.array_distinct(F.filter(F.array(whole, key, F.when(F.length(first) >= 5, first)), lambda v: v.isNotNull() & (v != "")))
    return F.array_sort(every, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))


def scrubbed(text: Column, names: Column, mark: str = "[name]") -> Column:
    """Text with every variant of the own name replaced, whatever its case."""
    return F.aggregate(names, F.coalesce(text, F.lit("")), lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?i)\b"), F.replace(n, F.lit(" "), F.lit(r"\W+")), F.lit(r"\b")), F.lit(mark)))


def resolved_name(names: DataFrame, registry: DataFrame, name: str, title: str, symbol: str) -> DataFrame:
    """Names with the one symbol whose title has the same key; several or none are refused with the reason."""
    keyed = registry.select(name_key(F.col(title)).alias("_key"), F.col(symbol).alias("_s")).groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_s"))
    met = names.withColumn("_k", name_key(F.col(name))).join(keyed, F.col("_k") == F.col("_key"), "left")
    return met.withColumns({"symbol": F.when(F.col("_n") == 1, F.col("_s")), "reason": F.when(F.col("_n").isNull(), "no such name").when(F.col("_n") > 1, "more than one")}).drop("_k", "_key", "_s", "_n")


def containing_names(names: DataFrame, registry: DataFrame, name: str, title: str, symbol: str) -> DataFrame:
    """name, symbol of registry titles that hold all the name's words: they meet on the words, and the counts must agree."""
    left = names.select(name, F.array_distinct(F.filter(name_words(F.col(name)), lambda w: ~w.isin(*SUFFIXES))).alias("_w")).where(F.size("_w") > 0)
    right = registry.select(F.col(symbol).alias("symbol"), F.explode(F.array_distinct(name_words(F.col(title)))).alias("_t"))
    met = left.withColumn("_need", F.size("_w")).select(name, "_need", F.explode("_w").alias("_t")).join(right, "_t")
    return met.groupBy(name, "_need", "symbol").agg(F.count(F.lit(1)).alias("_n")).where("_n = _need").select(name, "symbol")


def phrase_evidence(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """struct of how many distinct phrases of each category stand in a text as whole words, whatever their case."""
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), F.lit(" "))
    return F.struct(*[sum((F.contains(plain, F.lit(f" {p} ")).cast("int") for p in many), F.lit(0)).alias(k) for k, many in phrases.items()])


def classified(evidence: Column, categories: tuple[str, ...], code: Column, by_code: dict[str, str], least: int = 2) -> Column:
    """struct of category, confidence and reason: text evidence that leads beats a code, a code beats thin evidence, ties are refused."""
    best = F.greatest(*[evidence[k] for k in categories])
    whole = sum((evidence[k] for k in categories), F.lit(0))
    leaders = F.filter(F.array(*[F.when((evidence[k] == best) & (best > 0), F.lit(k)) for k in categories]), lambda k: k.isNotNull())
    coded = F.lit(None).cast("string")
    for c, k in by_code.items():
        coded = F.when(code == c, k).otherwise(coded)
    lead = F.when((F.size(leaders) == 1) & (best >= least), F.get(leaders, F.lit(0)))
    agreed = lead.isNotNull() & (lead == coded)
    category = F.coalesce(lead, coded)
    reason = F.when(agreed, "text and code").when(lead.isNotNull(), "text").when(coded.isNotNull(), "code").when(F.size(leaders) > 1, "tied evidence").otherwise("no evidence")
    return F.struct(category.alias("category"), F.when(category.isNull(), 0.0).when(lead.isNotNull(), F.when(agreed, 1.0).otherwise(best / whole)).otherwise(0.5).alias("confidence"), reason.alias("reason"))


def evidence_shares(evidence: Column, categories: tuple[str, ...]) -> Column:
    """Categories with their share of all evidence, the strongest first; equal ones by name."""
    whole = sum((evidence[k] for k in categories), F.lit(0))
    rows = F.array(*[F.struct((-evidence[k]).alias("o"), F.lit(k).alias("name"), F.when(whole > 0, evidence[k] / whole).otherwise(0.0).alias("share")) for k in categories])
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["name"].alias("name"), r["share"].alias("share")))


#: A figure in prose: its scale words and what they are worth.
SCALES = (("thousand", 1e3), ("million", 1e6), ("billion", 1e9))


def money(text: Column) -> Column:
    """Amounts such as $1,234.5 million, in the order they stand, as numbers."""
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\$ ?([0-9][0-9,]*(?:\.[0-9]+)?(?: (?:thousand|million|billion))?)"), F.lit(1))

    def number(h: Column) -> Column:
        scale = F.lit(1.0)
        for word, worth in SCALES:
            scale = F.when(F.endswith(h, F.lit(word)), worth).otherwise(scale)
        return F.replace(F.regexp_extract(h, r"^[0-9,]+(?:\.[0-9]+)?", 0), F.lit(","), F.lit("")).cast("double") * scale

    return F.transform(hits, number)


def cash_per_share(clause: Column) -> Column:
    """The amount a share is paid in cash; par values never count."""
    bare = F.regexp_replace(F.coalesce(clause, F.lit("")), r"(?i)par value (?:of )?\$ ?[0-9.]+(?: per share)?|\$ ?[0-9.]+ par value", " ")
    hit = F.regexp_extract(bare, r"(?i)\$ ?([0-9]+(?:\.[0-9]+)?) (?:in cash|per share)", 1)
    return F.when(hit != "", hit.cast("double"))


def exchange_ratio(clause: Column) -> Column:
    hit = F.regexp_extract(F.coalesce(clause, F.lit("")), r"(?i)([0-9]+\.[0-9]+) (?:of a share|shares? of)", 1)
    return F.when(hit != "", hit.cast("double"))


def distinct_within(values: Column, tolerance: float) -> Column:
    """Values that no one kept before them is within a relative tolerance of, in the order first seen."""
    near = lambda k, x: F.abs(k - x) <= tolerance * F.greatest(F.abs(k), F.abs(x))
    return F.aggregate(values, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda k: near(k, x)), kept).otherwise(F.concat(kept, F.array(x))))


def bounded(value: Column, low: float, high: float) -> Column:
    """struct of a figure, its confidence (none outside its bounds) and the flag that says so."""
    out = (value < low) | (value > high)
    return F.struct(value.alias("value"), F.when(out, 0.0).when(value.isNotNull(), 1.0).alias("confidence"), F.when(out, "out of bounds").alias("flag"))


def term_weights(documents: DataFrame, key: str, text: str, *, least: int = 2, most: float = 0.8) -> DataFrame:
    """key, term, weight: 1 + ln(tf) times ln((1 + n) / (1 + df)) + 1 over words and word pairs, each document's weights of length one.

    Terms of fewer than ``least`` documents or more than the share ``most`` of them weigh nothing.
    """
    w = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+", " "), " "), lambda x: (F.length(x) >= 2) & ~x.isin(*STOP_WORDS))
    words = documents.select(key, w.alias("_w"))
    pairs = F.zip_with(F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", F.lit(2), F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    tf = words.select(key, F.explode(F.concat("_w", pairs)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("_tf"))
    n = documents.agg(F.count(F.lit(1)).alias("_n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_df")).crossJoin(F.broadcast(n)).where((F.col("_df") >= least) & (F.col("_df") <= most * F.col("_n")))
    raw = tf.join(df, "term").withColumn("_x", (1 + F.ln("_tf")) * (F.ln((1 + F.col("_n")) / (1 + F.col("_df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_l"))
    return raw.join(norm, key).select(key, "term", (F.col("_x") / F.col("_l")).alias("weight"))


def projected(weights: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """Documents that weren't fitted, in the terms of those that were: only known terms count, and lengths are one again."""
    kept = weights.join(vocabulary.select("term").distinct(), "term", "left_semi")
    norm = kept.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_l"))
    return kept.join(norm, key).select(key, "term", (F.col("weight") / F.col("_l")).alias("weight"))


def unit_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Vectors of length one; one without length is null with the reason."""
    size = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))
    out = df.withColumn("_l", size)
    return out.withColumns({"reason": F.when(~(F.col("_l") > 0), "no length"), vector: F.when(F.col("_l") > 0, F.transform(vector, lambda x: x.cast("double") / F.col("_l")))}).drop("_l")


def candidates_by_rank(df: DataFrame, key: str, rank: str, filed: str, k: int) -> DataFrame:
    """The k candidate filings of each key, best form first, then the latest."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col(rank), F.col(filed).desc()))
    return df.withColumn("place", place).where(F.col("place") <= k)
