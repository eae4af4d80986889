"""Citation lines, where their documents are, and the closure of the citation graph."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrove.functions import rules, tables
from sourcegrove.functions.text import lines
from sourcegrove.operators import gates


def parsed_line(line: Column) -> Column:
    """struct(raw_text, org, code, title, ref_number) of a numbered reference line, else null."""
    raw = F.trim(F.replace(F.replace(line, F.lit(" "), F.lit(" ")), F.lit("​"), F.lit("")))
    number = F.regexp_extract(raw, r"^\[(\d+)\]\s*(.+)$", 1)
    body = F.trim(F.regexp_extract(raw, r"^\[(\d+)\]\s*(.+)$", 2))
    title = F.regexp_extract(body, r'"([^"]+)"', 1)

    def made(org: str, pattern: str, groups: tuple[int, ...]) -> tuple[Column, Column]:
        parts = [F.regexp_extract(body, pattern, g) for g in groups or (0,)]
        code = F.concat(F.upper(parts[0]), F.lit(" "), parts[1]) if len(parts) == 2 else parts[0]
        return body.rlike(pattern), F.struct(raw.alias("raw_text"), F.lit(org).alias("org"), code.alias("code"), title.alias("title"), number.cast("int").alias("ref_number"))

    head, *rest = [made(*p) for p in rules.REFERENCE_PATTERNS]
    found = reduce(lambda out, r: out.when(*r), rest, F.when(*head))
    return F.when((number != "") & ~F.lower(body).startswith("void"), found)


def parse_references(df: DataFrame, text: str = "text") -> DataFrame:
    """R2: the parsed lines of each row's text, with the other columns."""
    others = [c for c in df.columns if c != text]
    each = df.select(*others, F.posexplode(lines(F.coalesce(F.col(text), F.lit("")))).alias("line_no", "line"))
    return each.withColumn("ref", parsed_line(F.col("line"))).filter("ref is not null").select(*others, "line_no", "ref.*")


def resolve(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """Status, source_url and version of each (org, code).

    listing (folder_url, pos, link): the links of each folder or landing page that could be read, in page order. Links are absolute or
    relative to their folder. Organisations that need a web search look up the page "search:" + org + " " + code.
    """
    digits = F.replace(F.trim(F.regexp_replace("code", "[A-Z]+", "")), F.lit(" "), F.lit(""))
    number = F.element_at(F.split("code", r"\s+"), -1)
    kind = F.lower(F.element_at(F.split(F.trim("code"), r"\s+"), 1))
    folder = (
        F.when((F.col("org") == "3GPP") & (F.size(F.split(F.trim("code"), r"\s+")) == 2), F.concat(F.lit("https://www.3gpp.org/ftp/Specs/archive/"), F.split(number, r"\.")[0], F.lit("_series/"), number, F.lit("/")))
        .when((F.col("org") == "ETSI") & (F.length(digits) >= 6), F.format_string("https://www.etsi.org/deliver/etsi_%s/%s00_%s99/", F.when(kind.isin("ts", "tr"), kind).otherwise("ts"), F.expr("substring({0}, 1, length({0}) - 2)".format("replace(trim(regexp_replace(code, '[A-Z]+', '')), ' ', '')")), F.expr("substring({0}, 1, length({0}) - 2)".format("replace(trim(regexp_replace(code, '[A-Z]+', '')), ' ', '')"))))
        .when(F.col("org") == "ITU-T", F.concat(F.lit("https://www.itu.int/rec/T-REC-"), F.trim("code"), F.lit("/en")))
        .when(F.col("org").isin("GSMA", "ATIS", "IEEE", "O-RAN", "BBF", "MEF"), F.concat(F.lit("search:"), "org", F.lit(" "), "code"))
    )
    pages = listing.groupBy("folder_url").agg(F.array_sort(F.collect_list(F.struct("pos", "link"))).getField("link").alias("links"))

    def absolute(base: Column, link: Column) -> Column:
        root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
        return F.when(link.rlike("^[a-z]+://"), link).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), link))

    def last(link: Column) -> Column:
        return F.element_at(F.split(F.regexp_replace(link, "/+$", ""), "/"), -1)

    def first_of(links: Column, test) -> Column:
        return F.try_element_at(F.filter(links, test), F.lit(1))

    def with_slash(x: Column) -> Column:
        return F.when(x.endswith("/"), x).otherwise(F.concat(x, F.lit("/")))

    def look(df: DataFrame, url: str, out: str) -> DataFrame:
        return df.join(pages.select(F.col("folder_url").alias(url), F.col("links").alias(out)), url, "left")

    df = refs.withColumn("digits", digits).withColumn("folder", folder)
    df = look(df, "folder", "l1")
    df = df.withColumn("code_url", F.when(F.col("org") == "ETSI", with_slash(absolute(F.col("folder"), first_of(F.col("l1"), lambda x: last(x) == F.col("digits"))))))
    df = look(df, "code_url", "l2")
    versions = F.transform(F.filter("l2", lambda x: last(x).rlike(r"^\d")), lambda x: absolute(F.col("code_url"), x))
    df = look(df.withColumn("version_url", with_slash(F.array_max(versions))), "version_url", "l3")

    def pdf(x: Column) -> Column:
        return F.lower(x).endswith(".pdf")

    zip_link = F.array_max(F.filter("l1", lambda x: F.lower(x).endswith(".zip")))
    first_pdf = absolute(F.col("folder"), first_of(F.col("l1"), pdf))
    late_pdf = absolute(F.col("version_url"), first_of(F.col("l3"), pdf))
    searched = first_of(F.col("l1"), pdf)
    url = (
        F.when(F.col("org") == "IETF", F.concat(F.lit("https://www.rfc-editor.org/rfc/rfc"), F.trim("code"), F.lit(".html")))
        .when(F.col("l1").isNull(), F.lit(None))
        .when(F.col("org") == "3GPP", F.coalesce(absolute(F.col("folder"), zip_link), "folder"))
        .when(F.col("org") == "ETSI", F.coalesce(late_pdf, "version_url", "code_url"))
        .when(F.col("org") == "ITU-T", F.coalesce(first_pdf, "folder"))
        .otherwise(F.coalesce(searched, F.try_element_at("l1", F.lit(1))))
    )
    blocked = (F.col("org") == "ITU-T") & first_pdf.isNull() & F.col("l1").isNotNull() | F.col("folder").startswith("search:") & searched.isNull()
    df = df.withColumn("source_url", url)
    status = F.when(F.coalesce(blocked, F.lit(False)), "blocked").when(F.col("source_url").isNull(), "unresolved").otherwise("pending")
    return df.select(*refs.columns, status.alias("status"), "source_url", F.when(F.col("org") == "3GPP", zip_link).alias("version"))


def crawl(seeds: DataFrame, cites: DataFrame, most_levels: int | None = None) -> DataFrame:
    """G1: (org, code, level) of all documents reached from seeds (org, code) along cites (org, code, to_org, to_code).

    It ends where a level brings no new document, or after most_levels levels if that is given. Each level joins the last one's
    documents with their citations, takes away those visited, and is written to a folder of its own beside the others in the
    checkpoint folder, so lineage and plan stay short however many levels there are, and a lost executor costs one level.
    """
    spark = seeds.sparkSession
    folder = tables.new_folder(spark, "levels")
    first = seeds.select("org", "code").distinct().withColumn("level", F.lit(0))
    first.write.parquet(f"{folder}/0")

    def read(path: str) -> DataFrame:
        return spark.read.schema(first.schema).option("recursiveFileLookup", "true").parquet(path)

    for n in count(1):
        if most_levels is not None and n >= most_levels:
            break
        reached = read(f"{folder}/{n - 1}").join(cites, ["org", "code"]).select(F.col("to_org").alias("org"), F.col("to_code").alias("code")).distinct()
        reached.join(read(folder), ["org", "code"], "left_anti").withColumn("level", F.lit(n)).write.parquet(f"{folder}/{n}")
        if read(f"{folder}/{n}").isEmpty():
            break
    return read(folder)


def crawl_pages(seeds: DataFrame, listing: DataFrame, pages: DataFrame, cache: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """The records (org, code, level, cached, status, source_url, version, text, discovered) of all documents reached.

    seeds (org, code); listing as for `resolve`; pages (source_url, text). Each level takes the documents not visited yet: those with a record
    in the cache are replayed, text and citations; the others are resolved, read where their address is open, and for 3GPP kept only if
    they are no meeting contribution and are the document asked for. Citations of kept texts make the next level; the crawl ends where
    there is none. discovered is an array of (org, code, title, ref_number). The records go to `path` (one folder a level, written
    as wholes, to be given as cache to the next crawl), or to a table that ends with the session.
    """
    spark = seeds.sparkSession
    folder = path or tables.new_folder(spark, "crawl")
    kind = "org string, code string, level int, cached boolean, status string, source_url string, version string, text string, discovered array<struct<org:string,code:string,title:string,ref_number:int>>"
    columns = ["org", "code", "cached", "status", "source_url", "version", "text", "discovered"]
    frontier = seeds.select("org", "code").distinct()

    def records() -> DataFrame:
        return spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(folder)

    for n in count():
        todo = tables.written(frontier, "crawl-frontier")
        if todo.isEmpty():
            break
        fresh, known = todo, None
        if cache is not None:
            known = cache.join(todo, ["org", "code"], "left_semi").withColumn("cached", F.lit(True)).select(columns)
            fresh = todo.join(cache, ["org", "code"], "left_anti")
        found = resolve(fresh, listing)
        opened = gates.fetchable(found).select("org", "code", "source_url").join(pages, "source_url").select("org", "code", "text")
        right = (F.upper("org") != "3GPP") | ~gates.is_meeting_contribution(F.col("text")) & gates.is_requested_document(F.col("code"), F.col("text"))
        kept = opened.filter((F.coalesce("text", F.lit("")) != "") & right)
        cited = parse_references(kept.withColumn("text", gates.reference_section(F.col("text"))).select(F.col("org").alias("of_org"), F.col("code").alias("of_code"), "text"))
        cited = cited.groupBy(F.col("of_org").alias("org"), F.col("of_code").alias("code")).agg(F.array_sort(F.collect_list(F.struct("line_no", F.struct("org", "code", "title", "ref_number").alias("r")))).getField("r").alias("discovered"))
        made = found.join(kept, ["org", "code"], "left").join(cited, ["org", "code"], "left").withColumns({"cached": F.lit(False), "discovered": F.coalesce("discovered", F.array().cast(kind.rsplit("discovered ")[1]))}).select(columns)
        (made if known is None else made.unionByName(known)).withColumn("level", F.lit(n)).write.parquet(f"{folder}/{n}")
        new = spark.read.schema(kind).parquet(f"{folder}/{n}").select(F.explode("discovered").alias("r")).select("r.org", "r.code").distinct()
        frontier = new.join(records(), ["org", "code"], "left_anti")
    return records() if n else spark.createDataFrame([], kind)
