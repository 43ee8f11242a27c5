"""All queries of the scanning and redaction engine, with their SQL. All run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import keywords as kw
from palimpsest.functions import text as tx
from palimpsest.operators import batch, cleaning, graph, inspect, merge, office, redact, scan, slots, stores, verify
from palimpsest.plans import fixtures
from palimpsest.sources import documents, mail, opc, pdf
from palimpsest.session import table

WORDS = ["License", "MIT License", "Apache License", "token", "of the", "@", "all rights"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# SQL fragments -------------------------------------------------------------------------------------------------------

_B = "\n\r\x0b\x0c\x1c-\x1e\x85  "
LINE = f"[^{_B}]*(?:\r\n|[{_B}])|[^{_B}]+$"
PAT = "|".join(w.replace("(", "\\(").replace(")", "\\)").replace(".", "\\.") for w in kw.longest_first(kw.normalize(WORDS)))
BLANK = "[\\s\\x1c-\\x1f\x85   -     　]+"
LINES = f"""ls AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{LINE}') AS a FROM documents),
lines AS (SELECT doc_id, lang, source, unnest(a) AS line, CAST(generate_subscripts(a, 1) AS BIGINT) AS n FROM ls)"""
HITS = f"{LINES},\nhits AS (SELECT * FROM lines WHERE regexp_matches(line, '{PAT}', 'i'))"


def sql_context(text: str) -> str:
    first = f"instr({text}, regexp_extract({text}, '{PAT}', 0, 'i'))"
    window = f"CASE WHEN length({text}) > 500 THEN substring({text}, greatest(1, {first} - 110), {first} + 350 - greatest(1, {first} - 110)) ELSE {text} END"
    return f"substring(trim(regexp_replace({window}, '{BLANK}', ' ', 'g')), 1, 500)"


def sql_id(part: str, path: str, category: str, text: str) -> str:
    return f"substring(sha256('[' || to_json({part}) || ', ' || to_json({path}) || ', ' || to_json({category}) || ', ' || to_json({text}) || ']'), 1, 24)"


def sql_count(text: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, '{PAT}', 0, 'i')) AS BIGINT)"


FINDINGS = f"""{HITS},
findings AS (
  SELECT doc_id, lang, source, n, line, {sql_id("'text'", "CAST(n AS VARCHAR)", "'文字行'", "line")} AS id, {sql_context("line")} AS context, {sql_count("line")} AS match_count
  FROM hits
)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def found_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.line_findings(docs(spark, sf_dir), WORDS, ["doc_id", "lang", "source"])


# Lines and findings --------------------------------------------------------------------------------------------------


@query(f"WITH {LINES} SELECT doc_id, n, line FROM lines")
def q01_line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.explode_lines(docs(spark, sf_dir), ["doc_id"])


@query(f"WITH {HITS} SELECT doc_id, n, line FROM hits")
def q02_keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.matching_lines(docs(spark, sf_dir), WORDS, ["doc_id"])


@query(f"WITH {FINDINGS} SELECT doc_id, n, id, context, match_count, regexp_replace(line, '{PAT}', '', 'gi') AS cleaned FROM findings")
def q03_line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found_lines(spark, sf_dir)
    return f.select("doc_id", "n", "id", "context", F.size("matches").cast("long").alias("match_count"), redact.cleaned_line(F.col("text"), kw.spark_pattern(WORDS), False).alias("cleaned"))


@query(f"""WITH {HITS}, m AS (SELECT doc_id, n, regexp_extract_all(line, '{PAT}', 0, 'i') AS a FROM hits)
SELECT doc_id, n, CAST(generate_subscripts(a, 1) AS BIGINT) AS nth, unnest(a) AS found FROM m""")
def q04_matches_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_lines(spark, sf_dir).select("doc_id", "n", F.posexplode("matches").alias("p", "found")).select("doc_id", "n", (F.col("p") + 1).cast("long").alias("nth"), "found")


@query(f"""WITH {FINDINGS}, r AS (SELECT doc_id, count(*) AS findings, CAST(sum(match_count) AS BIGINT) AS match_count FROM findings GROUP BY doc_id)
SELECT d.doc_id AS doc_id, coalesce(findings, 0) AS findings, coalesce(match_count, 0) AS match_count, 'completed' AS status
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id""")
def q05_report_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = scan.report(found_lines(spark, sf_dir), ["doc_id"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs(spark, sf_dir).select("doc_id").join(r, "doc_id", "left").select("doc_id", zero("findings"), zero("match_count"), F.lit("completed").alias("status"))


@query(f"WITH {FINDINGS} SELECT lang, source, count(*) AS findings, CAST(sum(match_count) AS BIGINT) AS matches, count(DISTINCT doc_id) AS docs FROM findings GROUP BY lang, source")
def q06_counts_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found_lines(spark, sf_dir).select("lang", "source", "doc_id", F.size("matches").alias("m"))
    return f.groupBy("lang", "source").agg(F.count("*").alias("findings"), F.sum("m").cast("long").alias("matches"), F.count_distinct("doc_id").alias("docs"))


_LISTS = [["  License ", "token", "License", "", "MIT License"], ["a", "bb", "cc", "a "], [" ", ""], ["x" * 151]]


@query("""WITH t AS (SELECT * FROM (VALUES
  (1, ['  License ', 'token', 'License', '', 'MIT License']), (2, ['a', 'bb', 'cc', 'a ']), (3, [' ', '']), (4, [repeat('x', 151)])) v(list_id, words)),
k AS (SELECT list_id, list_filter(list_transform(words, lambda x: trim(x)), lambda x: length(x) > 0) AS a FROM t),
e AS (SELECT list_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM k),
f AS (SELECT list_id, w, min(i) AS i FROM e GROUP BY list_id, w),
o AS (SELECT list_id, array_agg(w ORDER BY i) AS kept, array_agg(w ORDER BY -length(w), i) AS longest_first, max(length(w)) AS longest FROM f GROUP BY list_id)
SELECT CAST(t.list_id AS BIGINT) AS list_id, CASE WHEN longest <= 150 THEN array_to_string(kept, '|') END AS kept, CASE WHEN longest <= 150 THEN array_to_string(longest_first, '|') END AS longest_first
FROM t LEFT JOIN o ON t.list_id = o.list_id""")
def q07_keyword_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_LISTS, 1)), "list_id long, words array<string>")
    kept = kw.normalized_column(F.col("words"))
    return rows.select("list_id", F.array_join(kept, "|").alias("kept"), F.array_join(kw.longest_first_column(kept), "|").alias("longest_first"))


@query(f"""WITH {HITS}, m AS (SELECT lower(unnest(regexp_extract_all(line, '{PAT}', 0, 'i'))) AS word FROM hits) SELECT word, count(*) AS n FROM m GROUP BY word""")
def q08_longest_first_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_lines(spark, sf_dir).select(F.explode("matches").alias("m")).groupBy(F.lower("m").alias("word")).agg(F.count("*").alias("n"))


# Redaction -----------------------------------------------------------------------------------------------------------

_BLOCK = f"array_to_string(list_transform(regexp_extract_all(text, '{LINE}'), lambda x: CASE WHEN regexp_matches(x, '{PAT}', 'i') THEN regexp_extract(x, '(\r?\n)?$') ELSE x END), '')"


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{PAT}', '', 'gi')) AS cleaned_sha256, CAST(length(regexp_replace(text, '{PAT}', '', 'gi')) AS BIGINT) AS cleaned_chars FROM documents")
def q09_clean_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", redact.clean_text(F.col("text"), WORDS).alias("c"))
    return d.select("doc_id", F.sha2(F.encode("c", "utf-8"), 256).alias("cleaned_sha256"), F.length("c").cast("long").alias("cleaned_chars"))


@query(f"SELECT doc_id, sha256({_BLOCK}) AS cleaned_sha256, CAST(length({_BLOCK}) AS BIGINT) AS cleaned_chars FROM documents")
def q10_clean_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", redact.clean_text(F.col("text"), WORDS, block=True).alias("c"))
    return d.select("doc_id", F.sha2(F.encode("c", "utf-8"), 256).alias("cleaned_sha256"), F.length("c").cast("long").alias("cleaned_chars"))


@query(f"""SELECT d.doc_id AS doc_id, l.doc_id IS NOT NULL AS selected,
  sha256(CASE WHEN l.doc_id IS NOT NULL THEN regexp_replace(text, '{PAT}', '', 'gi') ELSE text END) AS cleaned_sha256
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id""")
def q11_clean_selected_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("chosen", F.lit(True))
    d = docs(spark, sf_dir).select("doc_id", "text").join(chosen, "doc_id", "left")
    text = F.when(F.col("chosen"), redact.clean_text(F.col("text"), WORDS)).otherwise(F.col("text"))
    return d.select("doc_id", F.col("chosen").isNotNull().alias("selected"), F.sha2(F.encode(text, "utf-8"), 256).alias("cleaned_sha256"))


@query(f"WITH {FINDINGS} SELECT DISTINCT l.doc_id AS doc_id FROM labels l WHERE l.doc_id NOT IN (SELECT doc_id FROM findings)")
def q12_invalid_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    selection = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return redact.invalid_selection(selection, found_lines(spark, sf_dir), ["doc_id"])


@query(f"""SELECT lang, CAST(sum(len(regexp_extract_all(text, '{PAT}', 0, 'i'))) AS BIGINT) AS before_matches,
  CAST(sum(len(regexp_extract_all({_BLOCK}, '{PAT}', 0, 'i'))) AS BIGINT) AS after_matches FROM documents GROUP BY lang""")
def q13_before_after_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = F.lit(kw.spark_pattern(WORDS))
    after = redact.clean_text(F.col("text"), WORDS, block=True)
    return docs(spark, sf_dir).groupBy("lang").agg(F.sum(F.regexp_count("text", pattern)).cast("long").alias("before_matches"), F.sum(F.regexp_count(after, pattern)).cast("long").alias("after_matches"))


@query("SELECT doc_id FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) OR doc_id % 11 = 0")
def q14_stale_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that changed (every 7th here) or went (every 11th) since the scan."""
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    d = docs(spark, sf_dir)
    scanned = d.select("doc_id", digest(F.col("text")).alias("digest"))
    now = d.where("doc_id % 11 <> 0").select("doc_id", digest(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("digest"))
    return redact.stale(scanned, now, "doc_id", "digest")


_GUARDED = [("a.csv", "plain", False), ("a.csv", "with,comma", False), ("a.tsv", "tab\there", False), ("a.txt", "with,comma", False), ("a.csv", "plain", True), ("b.txt", "plain", True), ("a.tsv", 'quo"te', False)]


@query("""WITH t AS (SELECT * FROM (VALUES (1, 'a.csv', 'plain', false), (2, 'a.csv', 'with,comma', false), (3, 'a.tsv', 'tab' || chr(9) || 'here', false), (4, 'a.txt', 'with,comma', false),
  (5, 'a.csv', 'plain', true), (6, 'b.txt', 'plain', true), (7, 'a.tsv', 'quo"te', false)) v(id, path, word, block))
SELECT CAST(id AS BIGINT) AS id, path, NOT (regexp_matches(path, '\\.[ct]sv$') AND (block OR regexp_matches(word, '["\\r\\n]') OR (path LIKE '%.csv' AND word LIKE '%,%') OR (path LIKE '%.tsv' AND contains(word, chr(9))))) AS allowed FROM t""")
def q15_csv_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(_GUARDED, 1)], "id long, path string, word string, block boolean")
    csv, tsv = F.col("path").endswith(".csv"), F.col("path").endswith(".tsv")
    bad = F.col("word").rlike('["\r\n]') | (csv & F.col("word").contains(",")) | (tsv & F.col("word").contains("\t"))
    return rows.select("id", "path", (~((csv | tsv) & (F.col("block") | bad))).alias("allowed"))


# Other formats -------------------------------------------------------------------------------------------------------

JSON_WORDS = ["99", "7", "12"]
_JPAT = "|".join(kw.longest_first(JSON_WORDS))


@query(f"""SELECT event_id, {sql_id("'text'", "'1'", "'文字行'", "props")} AS id, CAST(len(regexp_extract_all(props, '{_JPAT}', 0, 'i')) AS BIGINT) AS match_count, false AS cleanable
FROM events WHERE regexp_matches(props, '{_JPAT}', 'i')""")
def q16_json_scan_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON is scanned by line but never cleaned."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("text"))
    f = scan.line_findings(e, JSON_WORDS, ["event_id"], cleanable=F.lit(False))
    return f.select("event_id", "id", F.size("matches").cast("long").alias("match_count"), "cleanable")


HTML_WORDS = ["the", "de la", "der", "ad"]
_HPAT = "|".join(kw.longest_first(HTML_WORDS))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, nth, text: closed paragraphs without their tags."""
    raw = F.regexp_extract_all("html", F.lit("(?s)<p>([^<]*)</p>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(raw).alias("p", "text")).select("page_id", (F.col("p") + 1).cast("long").alias("nth"), "text")


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1, 's') AS a FROM pages),
e AS (SELECT page_id, unnest(a) AS text, CAST(generate_subscripts(a, 1) AS BIGINT) AS nth FROM p)
SELECT page_id, nth, CAST(len(regexp_extract_all(text, '{_HPAT}', 0, 'i')) AS BIGINT) AS match_count, regexp_replace(text, '{_HPAT}', '', 'gi') AS cleaned FROM e WHERE regexp_matches(text, '{_HPAT}', 'i')""")
def q17_html_paragraph_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = kw.spark_pattern(HTML_WORDS)
    p = html_paragraphs(spark, sf_dir).where(F.col("text").rlike(pattern))
    return p.select("page_id", "nth", F.regexp_count("text", F.lit(pattern)).cast("long").alias("match_count"), F.regexp_replace("text", pattern, "").alias("cleaned"))


@query(f"""WITH p AS (SELECT page_id, regexp_extract_all(html, ' (?:href|class)="([^"]*)"', 1) AS a FROM pages), e AS (SELECT page_id, unnest(a) AS value FROM p)
SELECT page_id, value, count(*) AS n, false AS cleanable FROM e WHERE regexp_matches(value, '{_HPAT}', 'i') GROUP BY page_id, value""")
def q18_html_attr_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.explode(F.regexp_extract_all("html", F.lit(' (?:href|class)="([^"]*)"'), F.lit(1))).alias("value")
    found = table(spark, sf_dir, "pages").select("page_id", values).where(F.col("value").rlike(kw.spark_pattern(HTML_WORDS)))
    return found.groupBy("page_id", "value").agg(F.count("*").alias("n")).withColumn("cleanable", F.lit(False))


@query("""WITH p AS (SELECT page_id, regexp_extract_all(html, '<(script|style)>[^<]*', 0) AS a FROM pages), e AS (SELECT page_id, unnest(a) AS raw FROM p)
SELECT page_id, regexp_extract(raw, '<(script|style)>', 1) AS kind, regexp_extract(raw, '>([^<]*)', 1) AS body, false AS cleanable FROM e WHERE regexp_matches(raw, 'track|margin', 'i')""")
def q19_html_style_script_scan_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<(script|style)>[^<]*"), F.lit(0))).alias("raw"))
    found = raw.where(F.col("raw").rlike(kw.spark_pattern(["track", "margin"])))
    return found.select("page_id", F.regexp_extract("raw", "<(script|style)>", 1).alias("kind"), F.regexp_extract("raw", ">([^<]*)", 1).alias("body"), F.lit(False).alias("cleanable"))


@query(f"""WITH ls AS (SELECT conv_id, turn, regexp_extract_all(text, '{LINE}') AS a FROM conversations),
e AS (SELECT conv_id, turn, unnest(a) AS line, CAST(generate_subscripts(a, 1) AS BIGINT) - 1 AS n FROM ls)
SELECT conv_id, turn, n, {sql_id("'email:0.' || CAST(turn AS VARCHAR)", "CAST(n AS VARCHAR)", "'郵件純文字行'", "line")} AS id, CAST(len(regexp_extract_all(line, '{_HPAT}', 0, 'i')) AS BIGINT) AS match_count
FROM e WHERE regexp_matches(line, '{_HPAT}', 'i')""")
def q20_mail_line_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a message, its turns are the parts 0.turn; lines count from 0."""
    lines = scan.matching_lines(table(spark, sf_dir, "conversations"), HTML_WORDS, ["conv_id", "turn"]).withColumn("n", F.col("n") - 1)
    f = scan.findings(lines, HTML_WORDS, ["conv_id", "turn", "n"], F.concat(F.lit("email:0."), F.col("turn").cast("string")), F.col("n").cast("string"), F.lit("郵件純文字行"), "line", F.lit(True))
    return f.select("conv_id", "turn", "n", "id", F.size("matches").cast("long").alias("match_count"))


@query(f"""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
f AS (
  SELECT source, doc_id, rn, n_chars <= 10000 AND n_chars <= 50000 AS inspected, CASE WHEN n_chars <= 10000 AND n_chars <= 50000 THEN n_chars ELSE 0 END AS used FROM o WHERE rn = 1
  UNION ALL
  SELECT o.source, o.doc_id, o.rn, o.n_chars <= 10000 AND f.used + o.n_chars <= 50000, f.used + CASE WHEN o.n_chars <= 10000 AND f.used + o.n_chars <= 50000 THEN o.n_chars ELSE 0 END
  FROM f JOIN o ON o.source = f.source AND o.rn = f.rn + 1
)
SELECT doc_id, source, inspected FROM f""")
def q21_attachment_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attachments in order, up to 10,000 each and 50,000 in all: those passed over use no budget, so this is a fold."""
    return mail.within_budget(docs(spark, sf_dir), "source", "doc_id", "n_chars", 10_000, 50_000).select("doc_id", "source", "inspected")


# Relational checks ---------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT p_type AS shared, row_number() OVER (ORDER BY p_type) - 1 AS idx FROM (SELECT DISTINCT p_type FROM part))
SELECT p_partkey AS cell, idx, shared FROM part JOIN s ON p_type = shared""")
def q22_shared_string_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by way of a dictionary of shared strings."""
    part = table(spark, sf_dir, "part")
    shared = merge.numbered(part.select(F.col("p_type").alias("shared")).distinct(), "idx", "shared").withColumn("idx", F.col("idx") - 1)
    return part.select(F.col("p_partkey").alias("cell"), "p_type").join(shared, F.col("p_type") == F.col("shared")).select("cell", "idx", "shared")


@query("""SELECT DISTINCT p_brand || p_type AS shared FROM part WHERE p_size > 40 EXCEPT SELECT p_brand || p_type FROM part WHERE p_size <= 5""")
def q23_unused_shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touched by a selected cell (size over 40), not used by any that stays (size up to 5)."""
    part = table(spark, sf_dir, "part")
    shared = F.concat("p_brand", "p_type").alias("shared")
    return part.where("p_size > 40").select(shared).distinct().join(part.where("p_size <= 5").select(shared).distinct(), "shared", "left_anti")


@query("SELECT p_partkey FROM part WHERE p_size <= 40 AND (p_partkey % 97 = 5 OR (p_retailprice > 1500 AND p_partkey % 10 = 3))")
def q24_unselected_cells_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that were not selected (size up to 40) but differ after cleaning, or are gone: seeded faults that must be found."""
    before = table(spark, sf_dir, "part").where("p_size <= 40").select("p_partkey", F.col("p_name").alias("v"))
    part = table(spark, sf_dir, "part").where("p_size <= 40 AND p_partkey % 97 <> 5")
    after = part.select("p_partkey", F.when((F.col("p_retailprice") > 1500) & (F.col("p_partkey") % 10 == 3), F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("v"))
    return verify.changed(before, after, ["p_partkey"], "v")



@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def q25_missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return verify.missing_targets(edges, "l_orderkey", table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def q26_orphan_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.missing_targets(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").select("o_orderkey")


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS distinct_n FROM lineitem GROUP BY l_orderkey HAVING count(*) <> count(DISTINCT l_suppkey)")
def q27_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.duplicate_ids(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_suppkey")


@query("""WITH e AS (SELECT source, CASE WHEN doc_id % 50 = 0 THEN '../' ELSE 'word/' END || CAST(doc_id % 4000 AS VARCHAR) AS name, n_chars FROM documents)
SELECT source, count(*) AS entries, CAST(sum(n_chars) AS BIGINT) AS bytes, count(DISTINCT name) AS names, CAST(count(*) FILTER (WHERE name LIKE '../%') AS BIGINT) AS bad_names,
  count(*) <= 25000 AND sum(n_chars) <= 629145600 AND count(*) = count(DISTINCT name) AND count(*) FILTER (WHERE name LIKE '../%') = 0 AS ok FROM e GROUP BY source""")
def q28_zip_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 50 == 0, "../").otherwise("word/"), (F.col("doc_id") % 4000).cast("string"))
    return verify.package_guards(docs(spark, sf_dir).select("source", name.alias("name"), "n_chars"), "source", "name", "n_chars")


@query("""SELECT r_regionkey, bool_and(there) AS complete, array_to_string(array_agg(need ORDER BY need) FILTER (WHERE NOT there), '|') AS missing FROM (
  SELECT r_regionkey, need, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey AND n_name = need) AS there
  FROM region CROSS JOIN (SELECT DISTINCT n_name AS need FROM nation WHERE n_nationkey < 3) q) GROUP BY r_regionkey""")
def q29_required_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which regions have all required nations (the first three), and which are missing."""
    nation = table(spark, sf_dir, "nation")
    need = F.array(*[F.lit(r[0]) for r in nation.where("n_nationkey < 3").select("n_name").distinct().collect()])
    own = nation.groupBy("n_regionkey").agg(F.collect_set("n_name").alias("own"))
    joined = table(spark, sf_dir, "region").select("r_regionkey").join(own, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    missing = F.array_sort(F.array_except(need, F.coalesce("own", F.array().cast("array<string>"))))
    return joined.select("r_regionkey", (F.size(missing) == 0).alias("complete"), F.when(F.size(missing) > 0, F.array_join(missing, "|")).alias("missing"))


@query("""WITH RECURSIVE e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
r AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderkey % 10 = 1 UNION SELECT dst FROM r JOIN e ON src = node) SELECT node FROM r""")
def q30_reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, their customers, nations and regions as a graph of parts."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    edges = orders.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    edges = edges.unionByName(customer.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst"))).unionByName(nation.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")))
    return graph.reachable(edges, orders.where("o_orderkey % 10 = 1").select(node("o", "o_orderkey").alias("node")))


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def q31_dead_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("node")).distinct()
    return graph.dead_parts(table(spark, sf_dir, "part").select("p_partkey"), live, "p_partkey")


@query("""SELECT s_suppkey, count(r_regionkey) AS partners FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n_regionkey = r_regionkey
GROUP BY s_suppkey HAVING count(r_regionkey) <> 1""")
def q32_layout_chain_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier > nation > region stand for slide > layout > master, each with exactly one; region 2 is taken out."""
    chain = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return verify.not_exactly_one(chain, ["s_suppkey"], table(spark, sf_dir, "region").where("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("""SELECT v, 'left' AS side FROM (SELECT p_brand AS v FROM part WHERE p_size <= 25 EXCEPT ALL SELECT p_brand FROM part WHERE p_size > 25)
UNION ALL SELECT v, 'right' FROM (SELECT p_brand AS v FROM part WHERE p_size > 25 EXCEPT ALL SELECT p_brand FROM part WHERE p_size <= 25)""")
def q33_multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = lambda where: table(spark, sf_dir, "part").where(where).select(F.col("p_brand").alias("v"))
    return verify.multiset_difference(brand("p_size <= 25"), brand("p_size > 25"))


@query("""SELECT p_brand, count(*) AS slides, CAST(count(*) FILTER (WHERE p_size < 10) AS BIGINT) AS hidden, CAST(count(*) FILTER (WHERE p_type LIKE '%BRASS%') AS BIGINT) AS notes,
  max(p_retailprice) > 1900 AS tracking FROM part GROUP BY p_brand""")
def q34_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(
        F.count("*").alias("slides"), F.count_if(F.col("p_size") < 10).alias("hidden"), F.count_if(F.col("p_type").contains("BRASS")).alias("notes"), F.bool_or(F.col("p_retailprice") > 1900).alias("tracking")
    )


@query("SELECT conv_id, count(*) AS turns, sha256(array_to_string(array_agg(role || ':' || text ORDER BY turn, role, text), chr(10))) AS signature FROM conversations GROUP BY conv_id")
def q35_ordered_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sha2(F.encode(F.array_join(ordered, "\n"), "utf-8"), 256).alias("signature"))


@query("SELECT c_nationkey, array_to_string(list_sort(array_agg(DISTINCT c_mktsegment)), '|') AS labels FROM customer WHERE NOT (c_acctbal < 0 AND c_custkey % 2 = 1) GROUP BY c_nationkey")
def q36_label_signature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments stand for labels; those disabled (negative balance) and removed (odd) are history and do not count."""
    fields = F.create_map(
        F.lit("enabled"), F.when(F.col("c_acctbal") < 0, "0").otherwise("1"), F.lit("removed"), F.when((F.col("c_acctbal") < 0) & (F.col("c_custkey") % 2 == 1), "1").otherwise("0"), F.lit("id"), F.col("c_mktsegment")
    )
    active = table(spark, sf_dir, "customer").where(merge.label_signature(fields).isNotNull())
    return active.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), "|").alias("labels"))


@query("""WITH d AS (SELECT c_nationkey, c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END AS label FROM customer),
b AS (SELECT c_nationkey, min(c_custkey) AS base_ord, arg_min(label, c_custkey) AS base_label FROM d WHERE label IS NOT NULL GROUP BY c_nationkey)
SELECT b.c_nationkey AS c_nationkey, base_ord, base_label, CAST(count(*) FILTER (WHERE label <> base_label) AS BIGINT) AS conflicts FROM b JOIN d ON b.c_nationkey = d.c_nationkey GROUP BY ALL""")
def q37_base_label_and_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("label"))
    return merge.base_and_conflict(decks, ["c_nationkey"], "c_custkey", "label")


_FILES = [(1, "deck.pptx", False), (2, "minutes.docx", True), (3, "talk.pptx", False), (4, "sums.xlsx", False), (5, "plan.pdf", False), (6, "letter.RTF", False), (7, "ledger.xls", True)]


@query("""WITH f AS (SELECT * FROM (VALUES (1, 'deck.pptx', false), (2, 'minutes.docx', true), (3, 'talk.pptx', false), (4, 'sums.xlsx', false), (5, 'plan.pdf', false), (6, 'letter.RTF', false), (7, 'ledger.xls', true)) v(ord, path, kw)),
k AS (SELECT *, CASE WHEN regexp_matches(lower(path), '\\.(pptx|ppt|pps)$') THEN 'PowerPoint' WHEN regexp_matches(lower(path), '\\.(docx|doc|rtf)$') THEN 'Word' WHEN regexp_matches(lower(path), '\\.(xlsx|xls)$') THEN 'Excel' ELSE '' END AS kind FROM f),
g AS (SELECT *, kind = 'PowerPoint' AND count(*) OVER (PARTITION BY kind) >= 2 AS merged, min(ord) OVER (PARTITION BY kind) AS first_ord FROM k)
SELECT CAST(ord AS BIGINT) AS ord, path, kind, CASE WHEN merged AND ord = first_ord THEN 'merge' WHEN merged THEN 'member' WHEN kind <> '' AND (kind = 'Word' OR kw) THEN 'single' ELSE 'skipped' END AS role,
  CAST(CASE WHEN merged THEN first_ord WHEN kind <> '' AND (kind = 'Word' OR kw) THEN ord END AS BIGINT) AS task FROM g""")
def q38_batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(_FILES, "ord long, path string, has_keywords boolean")
    return merge.batch_plan(files, {"PowerPoint": True, "Word": False, "Excel": False}, {"PowerPoint": False, "Word": True, "Excel": False})


@query("SELECT CAST(0 AS BIGINT) AS source_ord, CAST(r_regionkey AS BIGINT) AS ord, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation")
def q39_ordered_union_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("ord"), F.col("r_name").alias("name"))
    return merge.ordered_union(region, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("ord"), F.col("n_name").alias("name")))


@query("""SELECT "merge", CAST(book AS BIGINT) AS book, CAST(ord AS BIGINT) AS ord, name, planned FROM (VALUES ('a', 0, 0, 'Summary', 'Summary'), ('a', 1, 0, 'Summary', 'Summary (3)'), ('a', 1, 1, 'Summary (2)', 'Summary (2)'), ('b', 0, 0, 'Data', 'Data'), ('b', 1, 0, 'DATA', 'DATA (2)'))
  v("merge", book, ord, name, planned)""")
def q40_sheet_name_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", 0, 0, "Summary"), ("a", 1, 0, "Summary"), ("a", 1, 1, "Summary (2)"), ("b", 0, 0, "Data"), ("b", 1, 0, "DATA")]
    return merge.plan_sheet_names(spark.createDataFrame(rows, "merge string, book long, ord long, name string"))



@query("""SELECT lower(split_part(p_name, ' ', 1)) AS name FROM part WHERE p_size <= 25 INTERSECT SELECT lower(split_part(p_name, ' ', 1)) FROM part WHERE p_size > 25""")
def q41_name_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that two books of a merge share, whatever their case."""
    names = lambda where: table(spark, sf_dir, "part").where(where).select(F.lower(F.substring_index("p_name", " ", 1)).alias("name"))
    return names("p_size <= 25").intersect(names("p_size > 25"))


@query("SELECT n_nationkey FROM nation WHERE n_nationkey % 7 = 3")
def q42_merge_layout_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a merged layout that are not the planned concatenation; seeded faults must be found."""
    nation = table(spark, sf_dir, "nation")
    actual = nation.select("n_nationkey", F.when(F.col("n_nationkey") % 7 == 3, F.upper(F.reverse("n_name"))).otherwise(F.col("n_name")).alias("v"))
    planned = nation.select("n_nationkey", F.col("n_name").alias("v"))
    return verify.changed(planned, actual, ["n_nationkey"], "v")


@query(f"SELECT conv_id, turn, substring(trim(regexp_replace(text, '{BLANK}', ' ', 'g')), 1, 500) AS context FROM conversations")
def q43_body_text_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.substring(tx.squeezed(F.col("text")), 1, 500).alias("context"))


@query("SELECT role, count(*) AS n, count(DISTINCT text) AS kinds, sha256(array_to_string(list_sort(array_agg(sha256(text))), ',')) AS signature FROM conversations GROUP BY role")
def q44_comment_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal for equal multisets of texts, in whatever order; sorted digests, not texts, are gathered."""
    own = F.sha2(F.encode("text", "utf-8"), 256)
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.count_distinct("text").alias("kinds"), F.sha2(F.encode(F.array_join(F.array_sort(F.collect_list(own)), ","), "utf-8"), 256).alias("signature")
    )


_NAMES = ["ins", "del", "p", "rPrChange", "moveFromRangeStart", "cellMerge", "delText", "t", "customXmlInsRangeEnd", "insert", "conflictDel", "Change", "moveFrom", "moveTo", "move"]


@query("""SELECT CAST(i AS BIGINT) AS i, name, name IN ('ins', 'del', 'rPrChange', 'moveFromRangeStart', 'cellMerge', 'delText', 'customXmlInsRangeEnd', 'conflictDel', 'moveFrom', 'moveTo') AS revision FROM (
  SELECT unnest(['ins', 'del', 'p', 'rPrChange', 'moveFromRangeStart', 'cellMerge', 'delText', 't', 'customXmlInsRangeEnd', 'insert', 'conflictDel', 'Change', 'moveFrom', 'moveTo', 'move']) AS name, unnest(range(15)) AS i)""")
def q45_revision_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_NAMES)), "i long, name string").withColumn("revision", tx.is_revision(F.col("name")))


@query("SELECT o_orderstatus, o_custkey, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) - 1 AS BIGINT) AS author FROM (SELECT DISTINCT o_orderstatus, o_custkey FROM orders)")
def q46_author_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors that are left, numbered anew without gaps."""
    kept = table(spark, sf_dir, "orders").select("o_orderstatus", "o_custkey").distinct()
    return kept.withColumn("author", (F.dense_rank().over(Window.partitionBy("o_orderstatus").orderBy("o_custkey")) - 1).cast("long"))


@query("""WITH c AS (SELECT l_orderkey % 1048576 AS r, (l_partkey * 7) % 16384 AS c FROM lineitem), d AS (SELECT DISTINCT r, c FROM c)
SELECT r, c, CASE WHEN c < 26 THEN chr(CAST(65 + c AS INTEGER)) WHEN c < 702 THEN chr(CAST(64 + c // 26 AS INTEGER)) || chr(CAST(65 + c % 26 AS INTEGER))
  ELSE chr(CAST(65 + (c - 702) // 676 AS INTEGER)) || chr(CAST(65 + ((c - 702) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (c - 702) % 26 AS INTEGER)) END || CAST(r + 1 AS VARCHAR) AS reference FROM d""")
def q47_a1_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1_048_576).alias("r"), ((F.col("l_partkey") * 7) % 16_384).alias("c")).distinct()
    return cells.withColumn("reference", tx.a1_reference(F.col("r"), F.col("c")))


@query("""SELECT event_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') THEN 'threaded' ELSE 'note' END AS kind FROM events WHERE event_type <> 'purchase'""")
def q48_thread_vs_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comment in a cell (user) that a thread holds is threaded, any other is a note."""
    e = table(spark, sf_dir, "events")
    threads = e.where("event_type = 'purchase'").select(F.col("user_id").alias("cell")).distinct()
    rest = e.where("event_type <> 'purchase'").select("event_id", "user_id")
    return rest.join(threads, F.col("user_id") == F.col("cell"), "left").select("event_id", F.when(F.col("cell").isNotNull(), "threaded").otherwise("note").alias("kind"))


@query("SELECT c_nationkey, arg_min(c_mktsegment, c_custkey) AS kept, count(DISTINCT c_mktsegment) > 1 AS conflict FROM customer GROUP BY c_nationkey")
def q49_store_merge_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.store_conflicts(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_mktsegment")


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL")
def q50_binding_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


_RUN_WORDS = ["the", "re", "de"]
_RPAT = "|".join(kw.longest_first(_RUN_WORDS))


@query(f"""SELECT conv_id, array_to_string(array_agg(text ORDER BY turn), '') AS before_text, regexp_replace(array_to_string(array_agg(text ORDER BY turn), ''), '{_RPAT}', '', 'gi') AS after_text
FROM conversations GROUP BY conv_id""")
def q51_run_offset_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the runs of a paragraph: what is cut out of each run, put together, is the cleaned paragraph."""
    runs = redact.clip_runs(table(spark, sf_dir, "conversations"), _RUN_WORDS, ["conv_id"], "turn", "text")
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", c))), lambda x: x[c]), "")
    return runs.groupBy("conv_id").agg(joined("text").alias("before_text"), joined("cleaned").alias("after_text"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events""")
def q52_graphics_state_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A setting holds until the next one: purchases set, the rest read."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    setting = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.last(setting, ignorenulls=True).over(w).alias("carried"))


@query("SELECT l_orderkey, CAST(sum(CAST(-round(l_quantity * 1000) - floor(round(l_discount * 100) * 1000 / 12) AS BIGINT)) AS BIGINT) AS advance FROM lineitem GROUP BY l_orderkey")
def q53_advance_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths and spacing (over a size of 12) in thousandths, negated as a TJ offset is."""
    part = (-F.round(F.col("l_quantity") * 1000) - F.floor(F.round(F.col("l_discount") * 100) * 1000 / 12)).cast("long")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(part).alias("advance"))



@query(f"""WITH a AS (SELECT lower(unnest(regexp_extract_all(text, '{_HPAT}', 0, 'i'))) AS word FROM documents), b AS (SELECT lower(unnest(regexp_extract_all(text, '{_HPAT}', 0, 'i'))) AS word FROM benchmark),
x AS (SELECT word, count(*) AS page_hits FROM a GROUP BY word), y AS (SELECT word, count(*) AS item_hits FROM b GROUP BY word)
SELECT x.word AS word, page_hits, coalesce(item_hits, 0) AS item_hits FROM x LEFT JOIN y ON x.word = y.word WHERE page_hits > coalesce(item_hits, 0)""")
def q54_pdf_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a page (documents) holds more often than its items (benchmark) account for."""
    found = F.explode(F.regexp_extract_all("text", F.lit(kw.spark_pattern(HTML_WORDS)), F.lit(0)))
    hits = lambda t, n: table(spark, sf_dir, t).select(found.alias("m")).groupBy(F.lower("m").alias("word")).agg(F.count("*").alias(n))
    joined = hits("documents", "page_hits").join(hits("benchmark", "item_hits"), "word", "left").withColumn("item_hits", F.coalesce("item_hits", F.lit(0).cast("long")))
    return joined.where("page_hits > item_hits")


_PROFILES = [
    '{"schema_version": 1, "name": "Ours", "keywords": ["a", "b"]}', '{"schema_version": 2, "name": "x", "keywords": ["a"]}', '{"schema_version": true, "name": "x", "keywords": ["a"]}',
    '{"schema_version": 1, "name": "", "keywords": ["a"]}', '{"schema_version": 1, "name": "x", "keywords": []}', '{"schema_version": 1, "name": "x", "keywords": ["a;b"]}', "[]", '{"schema_version": 1, "name": "x", "keywords": [1]}',
]


@query("""SELECT CAST(i AS BIGINT) AS i, problem FROM (VALUES (0, NULL), (1, 'schema_version'), (2, 'schema_version'), (3, 'name'), (4, 'keywords'), (5, 'keywords'), (6, 'no JSON object'), (7, 'keywords')) v(i, problem)""")
def q55_profile_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(_PROFILES)), "i long, raw string").select("i", kw.profile_problem(F.col("raw")).alias("problem"))


@query("""SELECT c_custkey, CAST(row_number() OVER (ORDER BY regexp_extract(n, '^(\\D*)', 1), CAST(regexp_extract(n, '(\\d+)', 1) AS BIGINT), c_custkey) AS BIGINT) AS place FROM (SELECT c_custkey, lower(replace(c_name, '#0', '#')) AS n FROM customer)""")
def q56_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by digit runs as numbers: a global order by range partitions, numbered by their counts."""
    key = tx.natural_key(F.regexp_replace("c_name", "#0", "#"))
    return merge.numbered(table(spark, sf_dir, "customer").select("c_custkey", key.alias("key")), "place", "key", "c_custkey").select("c_custkey", "place")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def q57_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of equal texts; grouped by digests, not texts."""
    return docs(spark, sf_dir).groupBy(F.sha2(F.encode("text", "utf-8"), 256).alias("d")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_PARTS = ["ppt/slides/slide12.xml", "ppt/slideMasters/slideMaster1.xml", "ppt/slideLayouts/slideLayout3.xml", "word/footer1.xml", "word/header2.xml", "word/document.xml", "ppt/notesSlides/notesSlide1.xml", "xl/comments1.xml", "docProps/app.xml", "word/styles.xml", "xl/workbook.xml"]


@query("""SELECT * FROM (VALUES ('ppt/slides/slide12.xml', '投影片 12'), ('ppt/slideMasters/slideMaster1.xml', '母片 · slideMaster1.xml'), ('ppt/slideLayouts/slideLayout3.xml', '版面配置 · slideLayout3.xml'),
  ('word/footer1.xml', '頁尾 · footer1.xml'), ('word/header2.xml', '頁首 · header2.xml'), ('word/document.xml', 'Word 正文／文字方塊'), ('ppt/notesSlides/notesSlide1.xml', '備忘稿／註腳 · notesSlide1.xml'),
  ('xl/comments1.xml', '註解 · comments1.xml'), ('docProps/app.xml', '文件屬性 · app.xml'), ('word/styles.xml', '樣式／編號設定'), ('xl/workbook.xml', 'xl/workbook.xml')) v(part, location)""")
def q58_location_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in _PARTS], "part string").withColumn("location", tx.location(F.col("part")))


@query("""WITH r AS (SELECT DISTINCT p_brand AS old, 'CleanStyle_' || substring(sha256(p_brand), 1, 12) AS new FROM part WHERE p_size < 10),
v AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '#' ELSE '' END || p_brand AS value FROM part)
SELECT p_partkey, value, CASE WHEN new IS NULL THEN value WHEN value LIKE '#%' THEN '#' || new ELSE new END AS renamed FROM v LEFT JOIN r ON old = ltrim(value, '#')""")
def q59_remap_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    remap = part.where("p_size < 10").select(F.col("p_brand").alias("old")).distinct().withColumn("new", tx.neutral_name("Style", F.col("old"), 12))
    values = part.select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, "#").otherwise(""), "p_brand").alias("value"))
    return redact.propagate(values, remap, "value")


@query(f"""WITH {FINDINGS}, v AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT f.doc_id AS doc_id, n, id, v.doc_id IS NULL AS cleanable FROM findings f LEFT JOIN v ON f.doc_id = v.doc_id""")
def q60_doc_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.veto(found_lines(spark, sf_dir), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id").select("doc_id", "n", "id", "cleanable")


@query("SELECT event_id, NOT max(event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cleanable FROM events")
def q61_sheet_veto_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands after a protected sheet (purchase) in package order (ts) is scan-only."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (~F.max(F.col("event_type") == "purchase").over(w)).alias("cleanable"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS n, CAST(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM lineitem)
SELECT l_orderkey, l_linenumber, begins, begins + n AS ends FROM s""")
def q62_segment_by_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, count) pairs cut a flat vector into segments by a running cursor."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("l_quantity").over(w), F.lit(0)).cast("long")
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("begins"), F.col("l_quantity").cast("long").alias("n"))
    return s.select("l_orderkey", "l_linenumber", "begins", (F.col("begins") + F.col("n")).alias("ends"))



@query(f"SELECT doc_id, regexp_replace(text, '{PAT}', '', 'gi') = regexp_replace({_BLOCK}, '{PAT}', '', 'gi') AS same FROM documents")
def q63_masked_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a cleaned copy differs from its source only where it may: masked texts compared by digest."""
    mask = lambda c: F.sha2(F.encode(F.regexp_replace(c, kw.spark_pattern(WORDS), ""), "utf-8"), 256)
    return docs(spark, sf_dir).select("doc_id", (mask(F.col("text")) == mask(redact.clean_text(F.col("text"), WORDS, block=True))).alias("same"))


_TARGETS = [
    ("ppt/slides/slide1.xml", "../slideLayouts/slideLayout2.xml"), ("", "word/document.xml"), ("word/document.xml", "media/image%201.png#frag"), ("word/document.xml", "/docProps/app.xml"),
    ("a/b/c.xml", "./d/../e.xml"), ("word/document.xml", "../../up.xml"), ("x.xml", "y+z.xml"),
]


@query("""SELECT CAST(i AS BIGINT) AS i, resolved, rels, owner FROM (VALUES (0, 'ppt/slideLayouts/slideLayout2.xml', 'ppt/slides/_rels/slide1.xml.rels', 'ppt/slides/slide1.xml'), (1, 'word/document.xml', '_rels/.rels', ''),
  (2, 'word/media/image 1.png', 'word/_rels/document.xml.rels', 'word/document.xml'), (3, 'docProps/app.xml', 'word/_rels/document.xml.rels', 'word/document.xml'), (4, 'a/b/e.xml', 'a/b/_rels/c.xml.rels', 'a/b/c.xml'),
  (5, NULL, 'word/_rels/document.xml.rels', 'word/document.xml'), (6, 'y+z.xml', '_rels/x.xml.rels', 'x.xml')) v(i, resolved, rels, owner)""")
def q68_path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(_TARGETS)], "i long, part string, target string")
    rels = tx.rels_path(F.col("part"))
    return rows.select("i", tx.resolve(F.col("part"), F.col("target")).alias("resolved"), rels.alias("rels"), tx.rels_owner(rels).alias("owner"))


# File formats, on generated documents -----------------------------------------------------------------------------------

_ENCODED = ["Blueberry 藍莓\r\n".encode(e) for e in ("utf-8", "utf-8-sig", "cp950")] + ["﻿Blueberry 藍莓\r\n".encode(e) for e in ("utf-16-le", "utf-16-be")] + [b"\xff\xff\xff"]


@query("""SELECT CAST(i AS BIGINT) AS i, encoding, chars FROM (VALUES (0, 'utf-8', 14), (1, 'utf-8-sig', 14), (2, 'cp950', 14), (3, 'utf-16-le', 15), (4, 'utf-16-be', 15), (5, NULL, NULL)) v(i, encoding, chars)""")
def q64_decode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(_ENCODED)], "i long, content binary")
    return documents.decode_text(rows, "content").select("i", "encoding", F.length("text").alias("chars"))


def _files(spark: SparkSession) -> DataFrame:
    rows = [("a.docx", fixtures.docx()), ("b.xlsx", fixtures.xlsx()), ("c.eml", fixtures.EML), ("d.pdf", fixtures.pdf()), ("e.docx", b"no package")]
    return spark.createDataFrame([(n, bytearray(b)) for n, b in rows], "source string, content binary")


@query("""SELECT * FROM (VALUES ('a.docx', 'word/document.xml', '/document/body/p', 'text', 'Ship Blueberry crates', false, 1)) v(source, part, path, kind, text, protected, matches)""")
def q65_opc_text_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword split over runs is found in the paragraph."""
    parts = opc.parts_of(_files(spark).where("source in ('a.docx', 'e.docx')")).where("error is null")
    pattern = kw.spark_pattern(["Blueberry"])
    return opc.paragraphs(opc.groups_of(parts)).where(F.col("text").rlike(pattern)).withColumn("matches", F.regexp_count("text", F.lit(pattern)))


@query("""SELECT * FROM (VALUES ('Subject', 'header', false, 1, true), ('0.0', 'text/plain', false, 1, true), ('0.1', 'text/plain', true, 1, false)) v(path, ctype, attached, matches, cleanable)""")
def q66_eml_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = mail.parts_of(_files(spark).where("source = 'c.eml'"))
    text = F.coalesce("text", F.col("payload").cast("string"), F.lit(""))
    return parts.select("path", "ctype", "attached", F.regexp_count(text, F.lit(kw.spark_pattern(["Blueberry"]))).alias("matches"), (~F.col("attached") & ~F.col("sealed")).alias("cleanable"))


@query("""SELECT page, op, text, safe, CAST(advance AS DOUBLE) AS advance FROM (VALUES (1, 'Tj', 'Open air', true, -5416.666667), (1, 'TJ', 'Blueberry', true, -6025.0), (1, 'Tj', 'x', false, 0.0)) v(page, op, text, safe, advance)""")
def q67_pdf_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdf.items_of(_files(spark).where("source = 'd.pdf'")).select("page", "op", "text", "safe", F.round("advance", 6).alias("advance"))


@query("""SELECT * FROM (VALUES ('xl/worksheets/sheet1.xml', 'A2', 's', 'Blueberry', NULL), ('xl/worksheets/sheet1.xml', 'B4', 's', 'Blueberry', NULL), ('xl/worksheets/sheet1.xml', 'C5', 'n', '42', '6*7')) v(part, ref, kind, value, formula)""")
def q69_xlsx_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opc.cells_of(_files(spark).where("source = 'b.xlsx'")).select("part", "ref", "kind", "value", "formula")


@query("""SELECT * FROM (VALUES ('e.docx', 'no readable package')) v(source, error)""")
def q70_error_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that cannot be read are rows, not failures."""
    return opc.parts_of(_files(spark).where("source in ('a.docx', 'e.docx')")).where("error is not null").select("source", "error")


@query("""SELECT * FROM (VALUES ('a.docx', 'Word', 0, 0, 1, false, NULL), ('b.xlsx', 'Excel', 0, 0, 0, false, NULL), ('e.docx', NULL, NULL, NULL, NULL, NULL, 'no readable package')) v(source, kind, slides, revisions, media, tracking, error)""")
def q71_package_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = inspect.stats_of(_files(spark).where("source in ('a.docx', 'b.xlsx', 'e.docx')"))
    return stats.select("source", "kind", "slides", "revisions", "media", "tracking", "error")


@query("""SELECT * FROM (VALUES ('a.docx', 2, NULL), ('b.xlsx', 4, NULL), ('e.docx', 0, 'no readable package')) v(source, edits, error)""")
def q72_clean_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits: two runs of a paragraph; two cells and the two runs of the shared string that no cell uses any more."""
    return office.clean_packages(_files(spark).where("source in ('a.docx', 'b.xlsx', 'e.docx')"), ["Blueberry"]).select("source", "edits", "error")


# All formats at once ----------------------------------------------------------------------------------------------------

_WORDS = ["Blueberry"]
_KEY = "0123456789ABCDEF0123456789ABCDEF"


def _all_files(spark: SparkSession) -> DataFrame:
    rows = [("a.docx", fixtures.docx()), ("b.xlsx", fixtures.xlsx()), ("c.eml", fixtures.EML), ("d.pdf", fixtures.pdf()), ("e.docx", b"no package"), ("f.txt", b"One\r\nBlueberry pie\r\n"), ("g.json", b'{"a": "blueberry"}'), ("h.docx", fixtures.styled())]
    return spark.createDataFrame([(n, "." + n.partition(".")[2], bytearray(b)) for n, b in rows], "source string, suffix string, content binary")


def _packages(spark: SparkSession, rows: list[tuple[str, bytes]]) -> DataFrame:
    return spark.createDataFrame([(n, "." + n.partition(".")[2], bytearray(b)) for n, b in rows], "source string, suffix string, content binary")




@query("""WITH v AS (SELECT * FROM (VALUES
  ('a.docx', 'word/document.xml', '/w:document/w:body/w:p', '文字段落', 'Ship Blueberry crates', 'Word 正文／文字方塊', true, NULL),
  ('b.xlsx', 'xl/sharedStrings.xml', '0', '共用文字（所有引用，只掃描）', 'Blueberry', 'xl/sharedStrings.xml', false, NULL),
  ('b.xlsx', 'xl/worksheets/sheet1.xml', 'cell:A2', '儲存格文字', 'Blueberry', 'xl/worksheets/sheet1.xml · A2', true, NULL),
  ('b.xlsx', 'xl/worksheets/sheet1.xml', 'cell:B4', '儲存格文字', 'Blueberry', 'xl/worksheets/sheet1.xml · B4', true, NULL),
  ('c.eml', 'email:0.0', '0', '郵件純文字行', 'Blueberry rows' || chr(13) || chr(10), '郵件正文 · 第 1 行', true, NULL),
  ('c.eml', 'headers', 'Subject', '郵件標題', 'Picking Blueberry', 'headers', true, NULL),
  ('c.eml', 'text', '1', '文字行', 'forty Blueberry trays', '附件 trays.txt · 第 1 行', false, '0.1'),
  ('d.pdf', 'page:1', '6', 'PDF 文字區塊（整個刪除）', 'Blueberry', 'PDF 第 1 頁 · 文字區塊 7', true, NULL),
  ('f.txt', 'text', '2', '文字行', 'Blueberry pie' || chr(13) || chr(10), '第 2 行', true, NULL),
  ('g.json', 'text', '1', '文字行', '{"a": "blueberry"}', '第 1 行', false, NULL),
  ('h.docx', 'word/document.xml', '/w:document/w:body/w:p[1]/w:pPr/w:pStyle/@{http://schemas.openxmlformats.org/wordprocessingml/2006/main}val', '內部名稱／屬性', 'BlueberryHead', 'Word 正文／文字方塊', true, NULL),
  ('h.docx', 'word/document.xml', '/w:document/w:body/w:p[2]/w:r/v:shape/@id', '內部名稱／屬性', 'Blueberry1', 'Word 正文／文字方塊', true, NULL),
  ('h.docx', 'word/document.xml', '/w:document/w:body/w:p[2]/w:r/v:fill/@link', '內部名稱／屬性', '#Blueberry1', 'Word 正文／文字方塊', false, NULL),
  ('h.docx', 'word/styles.xml', '/w:styles/w:style[1]/@{http://schemas.openxmlformats.org/wordprocessingml/2006/main}styleId', '內部名稱／屬性', 'BlueberryHead', '樣式／編號設定', true, NULL),
  ('h.docx', 'word/styles.xml', '/w:styles/w:style[1]/w:name/@{http://schemas.openxmlformats.org/wordprocessingml/2006/main}val', '內部名稱／屬性', 'Blueberry Head', '樣式／編號設定', true, NULL),
  ('h.docx', 'word/styles.xml', '/w:styles/w:style[2]/w:basedOn/@{http://schemas.openxmlformats.org/wordprocessingml/2006/main}val', '內部名稱／屬性', 'BlueberryHead', '樣式／編號設定', true, NULL)
) t(source, part, path, category, text, location, cleanable, outer_path)),
i AS (SELECT *, substring(sha256('[' || to_json(part) || ', ' || to_json(path) || ', ' || to_json(category) || ', ' || to_json(text) || ']'), 1, 24) AS own FROM v)
SELECT source, CASE WHEN outer_path IS NULL THEN own ELSE substring(sha256(outer_path || own), 1, 24) END AS id, part, path, category, location, cleanable FROM i""")
def q73_scan_all_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all formats to one table of findings; an attachment's finding has its path in its id and is scan-only."""
    found, _ = slots.scan_documents(_all_files(spark), _WORDS)
    return found.select("source", "id", "part", "path", "category", "location", "cleanable")


@query("""SELECT * FROM (VALUES ('a.docx', CAST(1 AS BIGINT), CAST(1 AS BIGINT), 'partial'), ('b.xlsx', 3, 3, 'completed'), ('c.eml', 3, 3, 'partial'), ('d.pdf', 1, 1, 'partial'), ('e.docx', 0, 0, 'failed'),
  ('f.txt', 1, 1, 'completed'), ('g.json', 1, 1, 'completed'), ('h.docx', 6, 6, 'completed')) v(source, findings, match_count, status)""")
def q74_scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.report(*slots.scan_documents(_all_files(spark), _WORDS))


@query("""SELECT * FROM (VALUES ('b.xlsx', 'b.cleaned.xlsx', 1, 2, NULL), ('c.eml', 'c.cleaned.eml', 1, 1, NULL), ('f.txt', 'f.cleaned.txt', 1, 0, NULL), ('g.json', NULL, 0, NULL, 'scan-only format')) v(source, name, changes, matches_left, error)""")
def q75_clean_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of two cells, a line of a mail but not its subject, a text line; the scan-only selection is refused."""
    files = _all_files(spark)
    found, _ = slots.scan_documents(files, _WORDS)
    chosen = found.where("source in ('b.xlsx', 'c.eml', 'f.txt', 'g.json') AND (cleanable OR source = 'g.json') AND path NOT IN ('cell:B4', 'Subject')")
    return cleaning.clean_selected(files, _WORDS, chosen.select("source", "id")).select("source", "name", "changes", "matches_left", "error")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


@query(f"""WITH n AS (SELECT 'CleanStyle_' || substring(sha256('BlueberryHead'), 1, 12) AS style, 'CleanShape_' || substring(sha256('Blueberry1'), 1, 12) AS shape),
v AS (SELECT 'a.docx' AS source, 'word/document.xml' AS part, '<w:document xmlns:w="{_W}"><w:body><w:p><w:r><w:t>Ship </w:t></w:r><w:r><w:t></w:t></w:r><w:r><w:t></w:t></w:r><w:r><w:t> crates</w:t></w:r></w:p></w:body></w:document>' AS xml
UNION ALL SELECT 'h.docx', 'word/document.xml', '<w:document xmlns:w="{_W}" xmlns:v="urn:schemas-microsoft-com:vml"><w:body><w:p><w:pPr><w:pStyle w:val="' || style || '"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><v:shape id="' || shape || '"/><v:fill link="#' || shape || '"/></w:r></w:p></w:body></w:document>' FROM n
UNION ALL SELECT 'h.docx', 'word/styles.xml', '<w:styles xmlns:w="{_W}"><w:style w:styleId="' || style || '"><w:name w:val="Head"/></w:style><w:style w:styleId="Plain"><w:basedOn w:val="' || style || '"/></w:style></w:styles>' FROM n)
SELECT source, part, 'modified' AS change, sha256(xml) AS digest FROM v""")
def q76_cleaned_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all parts that cleaning changed: texts, and names with all that refers to them."""
    files = _all_files(spark).where("suffix = '.docx'")
    cleaned = cleaning.clean_selected(files, _WORDS).where("error is null")
    after = opc.parts_of(cleaned.select("source", "content"))
    changed = cleaning.changed_parts(opc.parts_of(files), after)
    return changed.join(after.select("source", "part", F.sha2("payload", 256).alias("digest")), ["source", "part"])


def _stored(spark: SparkSession) -> DataFrame:
    other = "F" * 32
    rows = [("1.docx", fixtures.stored(_KEY, "<a>1</a>")), ("2.docx", fixtures.stored(_KEY, "<a >1</a>")), ("3.docx", fixtures.stored(other, "<b/>")), ("4.docx", fixtures.stored("no id", "<b/>")), ("5.docx", fixtures.docx())]
    return _packages(spark, rows)


@query(f"""SELECT * FROM (VALUES ('1.docx', '{_KEY.lower()}', '<a>1</a>', NULL), ('2.docx', '{_KEY.lower()}', '<a>1</a>', NULL), ('3.docx', '{"f" * 32}', '<b></b>', NULL), ('4.docx', NULL, NULL, 'a store without an id')) v(source, id, data, error)""")
def q77_custom_xml_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores by id, in one spelling of their XML, so that equal ones compare equal."""
    return stores.read_stores(_stored(spark)).select("source", "id", "data", "error")


def _books(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    rows = [("1.xlsx", fixtures.book({"Crop": "apples", "Sums": "total"}, ("Rate",))), ("2.xlsx", fixtures.book({"crop": "pears", "crop (2)": "plums"}, ("Tax",), "INDIRECT(&quot;crop!A1&quot;)")), ("3.xlsx", fixtures.book({"Notes": "none"}, ("RATE",)))]
    files = spark.createDataFrame([("m", i, f"{i}.xlsx") for i in (1, 2, 3)], "merge string, book long, source string")
    return files, _packages(spark, rows)


@query("""SELECT * FROM (VALUES ('plan', '1.xlsx', 'Crop', 'Crop'), ('plan', '1.xlsx', 'Sums', 'Sums'), ('plan', '2.xlsx', 'crop', 'crop (3)'), ('plan', '2.xlsx', 'crop (2)', 'crop (2)'), ('plan', '3.xlsx', 'Notes', 'Notes'),
  ('problem', '1.xlsx', 'shared name: rate', NULL), ('problem', '3.xlsx', 'shared name: rate', NULL), ('problem', '2.xlsx', 'formulas name sheets as text', NULL)) v(kind, source, what, planned)""")
def q78_workbook_merge_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, documents_ = _books(spark)
    plan, problems = batch.workbook_plan(files, documents_)
    named = plan.join(files, ["merge", "book"]).select(F.lit("plan").alias("kind"), "source", F.col("name").alias("what"), "planned")
    return named.unionByName(problems.select(F.lit("problem").alias("kind"), "source", F.col("problem").alias("what"), F.lit(None).cast("string").alias("planned")))


@query("""SELECT * FROM (VALUES ('body', 'bound pears', 'bound apples')) v(what, expected, actual)""")
def q79_word_merge_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merged document whose body is not that of its sources in order; comments and revisions are as they should be."""
    sources = _packages(spark, [("1.docx", fixtures.stored(_KEY, "<a/>")), ("2.docx", fixtures.stored(_KEY, "<a/>", "pears"))])
    files = spark.createDataFrame([("m", 1, "1.docx"), ("m", 2, "2.docx")], "merge string, book long, source string")
    return batch.word_differences(files, sources, _packages(spark, [("m", fixtures.stored(_KEY, "<a/>", "bound apples"))])).select("what", "expected", "actual")


@query("""SELECT * FROM (VALUES (0, 'first', false), (1, 'second', true), (2, 'third', false)) v(ord, notes, hidden)""")
def q80_slide_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides in the order of the presentation's list, with their notes."""
    return batch.slide_notes(_packages(spark, [("t.pptx", fixtures.talk(["first", "second", "third"], (1,)))])).select("ord", "notes", "hidden")


@query("""SELECT * FROM (VALUES ('[Content_Types].xml', 'modified'), ('docProps/app.xml', 'modified'), ('ppt/_rels/presentation.xml.rels', 'modified'), ('ppt/presentation.xml', 'modified'), ('ppt/notesSlides/notesSlide0.xml', 'deleted'), ('ppt/notesSlides/notesSlide1.xml', 'deleted'),
  ('ppt/slides/_rels/slide1.xml.rels', 'modified'), ('ppt/slides/_rels/slide2.xml.rels', 'modified'), ('ppt/slideMasters/slideMaster2.xml', 'deleted'), ('ppt/slideMasters/_rels/slideMaster2.xml.rels', 'deleted'), ('ppt/slideLayouts/slideLayout2.xml', 'deleted'),
  ('ppt/slideLayouts/_rels/slideLayout2.xml.rels', 'deleted'), ('ppt/theme/theme2.xml', 'deleted')) v(part, change)""")
def q81_prepared_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and the template that no slide uses are gone, lists and titles are in line, all else keeps its bytes."""
    deck = _packages(spark, [("t.pptx", fixtures.talk(["first", "second"]))])
    out = batch.prepare(deck, notes=True, prune=True).where("error is null")
    return cleaning.changed_parts(opc.parts_of(deck), opc.parts_of(out)).select("part", "change")
