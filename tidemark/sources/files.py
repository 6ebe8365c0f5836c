"""Readers of files, plain or gzipped: facts, filings, prices, scores, panels, peers, corpora, instance documents; and sinks.

Every reader declares its schema and gives long rows. A cell that can't be read is null and its row says why in ``problem``;
what to do about such rows is the caller's choice, after counting them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACT = "array<struct<start:string,end:string,val:double,form:string,filed:string>>"
FACTS = f"cik long, entityName string, facts map<string,map<string,struct<units:map<string,{FACT}>>>>"
RECENT = "accessionNumber array<string>, filingDate array<string>, form array<string>, primaryDocument array<string>"
SUBMISSIONS = f"cik string, name string, sic string, filings struct<recent:struct<{RECENT.replace(' array', ':array')}>>"


def open_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file, gzipped where its name says so, without a byte order mark: path, line."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^﻿", "").alias("line"))
    return lines


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents of a declared shape; one of another shape has its text in ``problem``."""
    declared = T.StructType.fromDDL(schema).add("problem", T.StringType())
    return spark.read.schema(declared).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "problem").json(path)


def read_yaml(path: str) -> dict:
    """Settings, on the driver; a mapping at the top or an error that names the file."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        found = yaml.safe_load(f)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found


def read_field(df: DataFrame, column: str, kind: str) -> DataFrame:
    """A text column as a type; what doesn't parse is null, with the column and text in ``problem``."""
    text = F.col(column).cast("string")
    parsed = text.try_cast(kind)
    bad = text.isNotNull() & (F.btrim(text) != "") & parsed.isNull()
    before = F.col("problem") if "problem" in df.columns else F.lit(None).cast("string")
    return df.withColumn("problem", F.when(bad, F.concat(F.lit(f"{column}: "), text)).otherwise(before)).withColumn(column, parsed)


def company_facts(spark: SparkSession, path: str, knowledge_date: str | None = None) -> DataFrame:
    """Long facts of payloads nested by taxonomy, tag and unit; ``ord`` keeps the order of the payload, which settles ties."""
    doc = read_json(spark, path, FACTS).where("facts is not null")
    a = doc.select("cik", F.explode("facts").alias("taxonomy", "tags"))
    b = a.select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    c = b.select("cik", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows"))
    d = c.select("cik", "taxonomy", "tag", "unit", F.posexplode("rows").alias("ord", "r"))
    out = d.select("cik", "taxonomy", "tag", "unit", F.col("r.start").try_cast("date").alias("start"), F.col("r.end").try_cast("date").alias("end"), F.col("r.val").alias("val"), F.col("r.form").alias("form"), F.col("r.filed").try_cast("date").alias("filed"), F.col("ord").cast("long").alias("ord"))
    return out if knowledge_date is None else out.where(F.col("filed") <= F.lit(knowledge_date).cast("date"))


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Filings of documents that hold them as parallel arrays: cik, name, sic, accession, filed, form, document, pos."""
    doc = read_json(spark, path, SUBMISSIONS).where("filings is not null")
    r = doc.select(F.col("cik").cast("long").alias("cik"), "name", "sic", F.col("filings.recent").alias("r"))
    rows = r.select("cik", "name", "sic", F.posexplode(F.arrays_zip("r.accessionNumber", "r.filingDate", "r.form", "r.primaryDocument")).alias("pos", "x"))
    return rows.select("cik", "name", "sic", F.col("x.accessionNumber").alias("accession"), F.col("x.filingDate").try_cast("date").alias("filed"), F.col("x.form").alias("form"), F.col("x.primaryDocument").alias("document"), "pos")


def filings(rows: DataFrame, forms: list[str], *, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Filings of some forms, the newest first in the order of the feed, at most so many an entity."""
    from pyspark.sql import Window

    kept = rows.where(F.col("form").isin(*forms))
    kept = kept if since is None else kept.where(F.col("filed") >= F.lit(since).cast("date"))
    kept = kept if until is None else kept.where(F.col("filed") <= F.lit(until).cast("date"))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy("cik").orderBy("pos")))
    return placed if limit is None else placed.where(F.col("place") <= limit)


def resolved_tickers(tickers: DataFrame, current: DataFrame, former: DataFrame, at: str) -> DataFrame:
    """ticker, cik, source: from the current list, a raw id, or a former listing that held on the date, in this order."""
    day = F.lit(at).cast("date")
    c = current.select(F.upper("ticker").alias("_t"), F.col("cik").alias("_c")).groupBy("_t").agg(F.min("_c").alias("_c"))
    old = former.where((F.col("since").isNull() | (F.col("since") <= day)) & (F.col("through").isNull() | (day <= F.col("through"))))
    o = old.groupBy(F.upper("ticker").alias("_ot")).agg(F.max_by("cik", F.struct("since", "cik")).alias("_o"))
    raw = F.regexp_extract(F.upper("ticker"), r"^(?:CIK)?0*([0-9]+)$", 1).try_cast("long")
    met = tickers.join(c, F.upper("ticker") == F.col("_t"), "left").join(o, F.upper("ticker") == F.col("_ot"), "left").withColumn("_r", raw)
    source = F.when(F.col("_c").isNotNull(), "current list").when(F.col("_r").isNotNull(), "id").when(F.col("_o").isNotNull(), "former listing").otherwise("unresolved")
    return met.select("ticker", F.coalesce("_c", "_r", "_o").alias("cik"), source.alias("source"))


def prices_by_file(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """symbol, date, close of a folder of Date,Close files; the symbol is the file's name."""
    df = spark.read.schema("Date date, Close double").option("header", True).csv(folder)
    out = df.select(F.upper(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv(?:\.gz)?$", 1)).alias("symbol"), F.col("Date").alias("date"), F.col("Close").alias("close")).where("date is not null and close is not null")
    out = out if start is None else out.where(F.col("date") >= F.lit(start).cast("date"))
    return out if end is None else out.where(F.col("date") <= F.lit(end).cast("date"))


def prices_long(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """symbol, date, close of a long file with ticker, date and close."""
    df = spark.read.schema("ticker string, date date, close double").option("header", True).csv(path).where("close is not null")
    out = df.select(F.upper("ticker").alias("symbol"), "date", "close")
    return out if symbols is None else out.where(F.col("symbol").isin(*symbols))


def price_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Prices by the name of their source."""
    readers = {"files": prices_by_file, "long": prices_long}
    if kind not in readers:
        raise ValueError(f"price sources are {', '.join(sorted(readers))}, not {kind}")
    return readers[kind](spark, path)


def capped(prices: DataFrame, today: str) -> DataFrame:
    return prices.where(F.col("date") <= F.lit(today).cast("date"))


def risk_free_rate(dates: DataFrame, rates: DataFrame, at: str) -> DataFrame:
    """dates with the rate published last on or before each of them, from whichever year's file."""
    from tidemark.operators.series import asof

    one = asof(dates.withColumn("_one", F.lit(1)), rates.withColumn("_one", F.lit(1)), "_one", at, "date", "rate", out="rate")
    return one.drop("_one")


def scores_file(spark: SparkSession, path: str, column: str, *, negate: bool = False, symbols: list[str] | None = None) -> DataFrame:
    """symbol, as_of, score of a column of a score panel; empty cells are left out, and the sign may be turned."""
    df = spark.read.option("header", True).csv(path)
    df = read_field(read_field(df, column, "double"), "as_of", "date").where(F.col(column).isNotNull() & F.col("as_of").isNotNull())
    score = -F.col(column) if negate else F.col(column)
    out = df.select(F.upper("ticker").alias("symbol"), "as_of", score.alias("score"))
    return out if symbols is None else out.where(F.col("symbol").isin(*symbols))


def panel_file(spark: SparkSession, path: str, keys: tuple[str, ...], known: tuple[str, ...]) -> DataFrame:
    """A wide panel: its keys, the known columns as numbers, and all others in a map named extras."""
    df = spark.read.option("header", True).csv(path)
    rest = [c for c in df.columns if c not in keys and c not in known]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).try_cast("double"))]
    extras = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>")
    return df.select(*[F.col(c).try_cast("date").alias(c) if c != "ticker" else F.upper(c).alias(c) for c in keys], *[F.col(c).try_cast("double").alias(c) for c in known if c in df.columns], extras.alias("extras"))


def peer_groups(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, "ticker string, cik long, accession string, filed date, fiscal_year int, peers array<string>, unresolved array<string>, method string, confidence double")


def mapped_panel(spark: SparkSession, path: str) -> DataFrame:
    """A panel whose values are a map: one row a ticker, date and name."""
    doc = read_json(spark, path, "rows array<struct<ticker:string,as_of:date,values:map<string,double>,error:string>>")
    rows = doc.select(F.explode("rows").alias("r"))
    return rows.select("r.ticker", "r.as_of", F.explode_outer("r.values").alias("name", "value"))


def corpora(spark: SparkSession, path: str) -> DataFrame:
    """Documents kept by date, then ticker: as_of, ticker, text, filed, accession."""
    doc = read_json(spark, path, "by_date map<string,map<string,struct<item1:string,filed:date,accession:string>>>")
    a = doc.select(F.explode("by_date").alias("d", "m")).select(F.col("d").try_cast("date").alias("as_of"), F.explode("m").alias("ticker", "x"))
    return a.select("as_of", "ticker", F.col("x.item1").alias("text"), F.col("x.filed").alias("filed"), F.col("x.accession").alias("accession"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Priced rows and skips as one table: a row without a positive multiple has a reason and a category."""
    doc = read_json(spark, path, "target string, observations array<struct<ticker:string,as_of:date,sub_vertical:string,multiple:double>>, skips array<struct<ticker:string,as_of:date,reason:string,category:string>>")
    o = doc.select(F.explode("observations").alias("o")).select("o.*").withColumns({"reason": F.when(~(F.col("multiple") > 0), "multiple is not positive"), "category": F.when(~(F.col("multiple") > 0), "refused")}).withColumn("multiple", F.when(F.col("multiple") > 0, F.col("multiple")))
    s = doc.select(F.explode("skips").alias("s")).select("s.*")
    return o.unionByName(s, allowMissingColumns=True)


def instance_facts(spark: SparkSession, path: str) -> DataFrame:
    """Dimensioned facts of instance documents kept as JSON."""
    doc = read_json(spark, path, "facts array<struct<tag:string,value:double,unit:string,start:date,end:date,dimensions:map<string,string>>>")
    return doc.select(F.explode("facts").alias("f")).select("f.tag", F.col("f.value").alias("val"), "f.unit", "f.start", "f.end", F.col("f.dimensions").alias("dims"))


def parse_instance(documents: DataFrame, key: str, xml: str) -> DataFrame:
    """key, tag, val, unit, start, end, dims of XML instances: facts meet their contexts and units by id.

    Documents are parsed by the standard library, one at a time in the task that holds them.
    """
    schema = T.StructType([documents.schema[key], *T.StructType.fromDDL("tag string, val double, unit string, start date, end date, dims map<string,string>")])

    def local(tag: str) -> str:
        return tag.rsplit("}", 1)[-1]

    def run(frames):
        import pandas as pd
        from xml.etree import ElementTree

        for frame in frames:
            rows = []
            for k, body in zip(frame[key], frame[xml], strict=True):
                try:
                    root = ElementTree.fromstring(body)
                except (ElementTree.ParseError, TypeError):
                    continue
                contexts, units = {}, {}
                for node in root:
                    if local(node.tag) == "context":
                        parts = {local(x.tag): (x.text or "").strip() for x in node.iter() if local(x.tag) in ("startDate", "endDate", "instant")}
                        dims = {x.attrib["dimension"]: (x.text or "").strip() for x in node.iter() if "dimension" in x.attrib}
                        contexts[node.attrib.get("id")] = (parts.get("startDate"), parts.get("endDate") or parts.get("instant"), dims)
                    elif local(node.tag) == "unit":
                        names = [(x.text or "").strip().rsplit(":", 1)[-1] for x in node.iter() if local(x.tag) == "measure"]
                        units[node.attrib.get("id")] = "/".join(names)
                for node in root:
                    context = contexts.get(node.attrib.get("contextRef"))
                    if context is None:
                        continue
                    try:
                        value = float((node.text or "").strip())
                    except ValueError:
                        continue
                    start, end, dims = context
                    rows.append((k, local(node.tag), value, units.get(node.attrib.get("unitRef")), start, end, dims))
            out = pd.DataFrame(rows, columns=[f.name for f in schema])
            for c in ("start", "end"):
                out[c] = pd.to_datetime(out[c], errors="coerce").dt.date
            yield out

    return documents.select(key, xml).mapInPandas(run, schema)


def canonical(column: Column, kind: T.DataType) -> Column:
    """A value as it is written down: numbers at six places, what is no number as null, arrays and structs likewise."""
    if isinstance(kind, T.DoubleType | T.FloatType):
        x = column.cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.round(x, 6))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*[canonical(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    return column


def to_json(df: DataFrame, out: str = "json") -> DataFrame:
    """One canonical JSON text a row: sorted keys, rounded numbers, nulls written."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return df.select(F.to_json(F.struct(*[canonical(F.col(f.name), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"}).alias(out))


def digests(spark: SparkSession, paths: str) -> DataFrame:
    """path and sha256 of whole files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def cached(df: DataFrame, folder: str, key: str) -> DataFrame:
    """A result kept under a digest of what it was made from; made anew where there is none."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{key}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
