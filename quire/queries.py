"""Every query of the core library by name, with the SQL that states the same result.

The SQL is written from the meaning of each operator, not from the plan: nesting walks row by row, runs join neighbours, and so on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify, text
from quire.functions import sql as sqlfunctions
from quire.functions.jsontext import set_json_path
from quire.operators import batch, blocks, completion, giants, manifest, phrases, registry, render, review, segment, tables, validate
from quire.plans import folder, views
from quire.sources import ooxml, records

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------- inputs


def _paras(spark: SparkSession, d: str) -> DataFrame:
    return blocks.paragraphs(views.view(spark, d, views.PARA, "events"))


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    return segment.segments(_paras(spark, d))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.procedure(_segmented(spark, d))


def _table_rows(spark: SparkSession, d: str) -> DataFrame:
    t = views.view(spark, d, views.TABLES, "part")
    return t.select("doc_id", "table_ord", "row_ord", F.slice(F.array("c1", "c2", "c3"), F.lit(1), F.col("n_cols").cast("int")).alias("cells"))


def _headings(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.HEADINGS, "part")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.FILES, "part")


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    return validate.post_process(views.view(spark, d, views.PAYLOADS, "orders"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return completion.read_attempts(views.view(spark, d, views.RESPONSES, "supplier"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


_UNITS = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\b[Ss]ec(tion|\.)\s*(\d+(\.\d+)*)\b', 'Section \2', 'g'), '(\d)\s*\*g\*', '\1 × g', 'g'), '(\d)\s*_g_', '\1 × g', 'g'), '(\d)\s*[xX]\s*g\b', '\1 × g', 'g'),
  '(\d)\s*[oO]\s*([CF])\b', '\1°\2', 'g'), '(\d+(\.\d+)?)\s*°\s*([CF])\b', '\1 °\3', 'g')"""
_PLAIN = r"regexp_replace(regexp_replace(raw_text, '\*\*(.+?)\*\*', '\1', 'g'), '_(.+?)_', '\1', 'g')"
_CALLOUT = rf"""CASE WHEN regexp_matches({_PLAIN}, '^(important|warning|caution)\s*[:\-–—]', 'i') THEN 'caution'
  WHEN regexp_matches({_PLAIN}, '^(critical|crucial)\s*[:\-–—]', 'i') THEN 'critical'
  WHEN regexp_matches({_PLAIN}, '^tip\s*[:\-–—]', 'i') THEN 'tip' WHEN regexp_matches({_PLAIN}, '^note\s*[:\-–—]', 'i') THEN 'note'
  WHEN regexp_matches({_PLAIN}, '\b(critical|critical step|protocol will fail|crucial)\b', 'i') THEN 'critical'
  WHEN regexp_matches({_PLAIN}, '\b(important|warning|caution|hazard|toxic|corrosive|flammable|carcinogen|biohazard|radiation|rnase|dnase|keep on ice|avoid freeze|sensitive to)\b', 'i') THEN 'caution'
  WHEN regexp_matches({_PLAIN}, '\b(shortcut|to improve|for best results|works well)\b', 'i') THEN 'tip'
  WHEN regexp_matches({_PLAIN}, '\b(see section|refer to|for more information|species-specific|see also|cross-reference)\b', 'i') THEN 'note' END"""
_STOP = rf"regexp_matches({_PLAIN}, '\b(pause point|safe stopping point|can be stored|may be stored|can be left|store at this stage|can stop here|overnight at)\b', 'i')"
_WITH = rf"""WITH RECURSIVE para AS ({views.PARA}), p AS (
 SELECT doc_id, pos, style_name, list_level, style_name LIKE 'List%' AS is_list, style_name = 'List Number' AS is_numbered, trim(regexp_replace(text, ' {{2,}}', ' ', 'g')) AS raw_text, {_UNITS} AS text,
  text AS marked FROM para), lev AS (
 SELECT *, CASE style_name WHEN 'Heading 1' THEN 1 WHEN 'Heading 2' THEN 2 WHEN 'Heading 3' THEN 3 ELSE
   CASE WHEN lower(raw_text) IN ('overview', 'materials', 'procedure', 'notes & variants', 'notes and variants', 'references', 'prerequisites') THEN 1
    WHEN raw_text = upper(raw_text) AND raw_text <> lower(raw_text) AND len(string_split(raw_text, ' ')) <= 8 THEN 2 ELSE 0 END END AS heading_level,
  CASE WHEN {_CALLOUT} IS NOT NULL THEN 'callout_' || {_CALLOUT} WHEN {_STOP} THEN 'stopping_point' WHEN is_list THEN 'step' ELSE 'prose' END AS class
 FROM p), marks AS (
 SELECT doc_id, pos AS from_pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), 9223372036854775807) AS to_pos,
  CASE lower(raw_text) WHEN 'notes and variants' THEN 'notes' ELSE lower(raw_text) END AS role
 FROM lev WHERE heading_level = 1 AND lower(raw_text) IN ('overview', 'materials', 'procedure', 'notes and variants', 'references')), seg AS (
 SELECT l.*, coalesce(m.role, 'pre_overview') AS segment FROM lev l LEFT JOIN marks m ON l.doc_id = m.doc_id AND l.pos > m.from_pos AND l.pos < m.to_pos WHERE l.heading_level <> 1)"""
_PROC = _WITH + """, proc AS (
 SELECT s.*, (SELECT count(*) FROM seg h WHERE h.segment = 'procedure' AND h.heading_level = 2 AND h.doc_id = s.doc_id AND h.pos <= s.pos) AS section_no,
  coalesce((SELECT max_by(h.raw_text, h.pos) FROM seg h WHERE h.segment = 'procedure' AND h.heading_level = 2 AND h.doc_id = s.doc_id AND h.pos <= s.pos), 'Procedure') AS heading
 FROM seg s WHERE s.segment = 'procedure' AND s.heading_level = 0), edge AS (
 SELECT doc_id, section_no, min(pos) FILTER (WHERE class = 'prose') AS first_prose, min(pos) FILTER (WHERE class IN ('step', 'stopping_point')) AS first_step FROM proc GROUP BY ALL), kinds AS (
 SELECT p.*, CASE WHEN class LIKE 'callout_%' THEN 'callout' WHEN class = 'prose' THEN CASE WHEN pos = first_prose AND pos < coalesce(first_step, 9223372036854775807) THEN 'preamble' ELSE 'step' END ELSE class END AS kind
 FROM proc p JOIN edge USING (doc_id, section_no)), sections AS (
 SELECT * FROM kinds WHERE (doc_id, section_no) IN (SELECT (doc_id, section_no) FROM kinds WHERE kind <> 'preamble'))"""
_TREE = _PROC + """, steps AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) - 1 AS seq FROM sections WHERE kind IN ('step', 'stopping_point')), walk AS (
 SELECT doc_id, section_no, seq, pos, kind, text, 0 AS depth, [seq] AS spine, kind AS root FROM steps WHERE seq = 0
 UNION ALL
 SELECT s.doc_id, s.section_no, s.seq, s.pos, s.kind, s.text, d.depth, list_append(list_slice(w.spine, 1, d.depth), s.seq), CASE WHEN d.depth = 0 THEN s.kind ELSE w.root END
 FROM walk w JOIN steps s ON s.doc_id = w.doc_id AND s.section_no = w.section_no AND s.seq = w.seq + 1,
 LATERAL (SELECT CAST(CASE WHEN s.class <> 'step' OR s.list_level <= 1 THEN 0 ELSE least(s.list_level - 1, len(w.spine)) END AS INT) AS depth) d), tree AS (
 SELECT *, CASE WHEN depth > 0 THEN spine[depth] END AS parent_seq, NOT (depth > 0 AND root = 'stopping_point') AS rendered FROM walk)"""

# ---------------------------------------------------------------- flagship


@query(_WITH + " SELECT segment, class, count(*) AS n FROM seg GROUP BY ALL")
def segment_classes(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).groupBy("segment", "class").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text functions


@query(_WITH + " SELECT pos, raw_text, length(raw_text) AS n_chars FROM p")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return _paras(spark, d).select("pos", "raw_text", F.length("raw_text").cast("long").alias("n_chars"))


@query(_WITH + rf" SELECT pos, {_PLAIN} AS plain, trim(regexp_replace({_PLAIN}, '[:;.,]+$', '')) AS title FROM p")
def strip_markers(spark: SparkSession, d: str) -> DataFrame:
    return _paras(spark, d).select("pos", text.strip_markers(F.col("raw_text")).alias("plain"), text.clean_title(F.col("raw_text")).alias("title"))


@query(
    _WITH
    + r""", t AS (SELECT pos, unnest(regexp_extract_all(marked, '_\*\*.+?\*\*_|\*\*.+?\*\*|_.+?_|[^*_]+|[*_]')) AS t, generate_subscripts(regexp_extract_all(marked, '_\*\*.+?\*\*_|\*\*.+?\*\*|_.+?_|[^*_]+|[*_]'), 1) - 1 AS token_no FROM p)
 SELECT pos, token_no, CASE WHEN t LIKE '**%' AND length(t) > 4 THEN t[3:-3] WHEN t[1] = '_' AND length(t) > 2 THEN t[2:-2] ELSE t END AS text, t LIKE '**%' AND length(t) > 4 AS bold, t[1] = '_' AND length(t) > 2 AS italic FROM t"""
)
def inline_tokens(spark: SparkSession, d: str) -> DataFrame:
    para = views.view(spark, d, views.PARA, "events")
    return para.select("pos", F.posexplode(text.inline_tokens(F.col("text"))).alias("token_no", "t")).select("pos", F.col("token_no").cast("long").alias("token_no"), "t.text", "t.bold", "t.italic")


@query(_WITH + " SELECT pos, text, text <> marked AS changed FROM p")
def normalize_units(spark: SparkSession, d: str) -> DataFrame:
    para = views.view(spark, d, views.PARA, "events")
    out = text.normalize_units(F.col("text"))
    return para.select("pos", out.alias("text"), (out != F.col("text")).alias("changed"))


@query(_WITH + r" SELECT pos, regexp_replace(marked, '\b[Ss]ec(tion|\.)\s*(\d+(\.\d+)*)\b', 'Section \2', 'g') AS text FROM p WHERE regexp_matches(marked, '\b[Ss]ec(tion|\.)\s*\d')")
def normalize_xrefs(spark: SparkSession, d: str) -> DataFrame:
    para = views.view(spark, d, views.PARA, "events")
    return para.where(F.rlike("text", F.lit(r"\b[Ss]ec(?:tion|\.)\s*\d"))).select("pos", text.normalize_cross_references(F.col("text")).alias("text"))


@query(
    _WITH
    + r""" SELECT pos, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(raw_text, '\[(\d+)\]', 1), lambda x: CAST(x AS BIGINT)))), ',') AS refs,
 trim(regexp_replace(regexp_replace(raw_text, '\[\d+\]', '', 'g'), ' {2,}', ' ', 'g')) AS cleaned FROM p WHERE raw_text LIKE '%[%'"""
)
def footnote_refs(spark: SparkSession, d: str) -> DataFrame:
    p = _paras(spark, d).where(F.contains("raw_text", F.lit("[")))
    return p.select("pos", F.array_join(text.footnote_refs(F.col("raw_text")).cast("array<string>"), ",").alias("refs"), text.without_footnote_refs(F.col("raw_text")).alias("cleaned"))


_DATE = r"""CASE WHEN regexp_matches({c}, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})') THEN
  lpad(regexp_extract({c}, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 1), 2, '0') || '/' || lpad(regexp_extract({c}, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 2), 2, '0') || '/' || regexp_extract({c}, '(\d{{1,2}})[/\-](\d{{1,2}})[/\-](\d{{4}})', 3)
 WHEN regexp_matches({c}, '[A-Za-z]{{3,}}\s+\d{{4}}') THEN lpad(coalesce(nullif(regexp_extract({c}, '(\d{{1,2}})\s+[A-Za-z]', 1), ''), '1'), 2, '0') || '/' ||
  lpad(CAST(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(regexp_extract({c}, '([A-Za-z]{{3}})[A-Za-z]*\s+\d{{4}}', 1))) AS VARCHAR), 2, '0') || '/' || regexp_extract({c}, '[A-Za-z]\s+(\d{{4}})', 1) END"""


@query(_WITH + " SELECT pos, " + _DATE.format(c="raw_text") + " AS date FROM p WHERE " + _DATE.format(c="raw_text") + " IS NOT NULL")
def normalize_dates(spark: SparkSession, d: str) -> DataFrame:
    return _paras(spark, d).select("pos", text.normalize_date(F.col("raw_text")).alias("date")).where("date is not null")


@query(
    _WITH
    + r""" SELECT pos, callout, trim(regexp_replace(raw_text, '^(important|warning|caution|note|tip|critical|crucial)\s*[:\-–—]\s*', '', 'i')) AS body FROM (SELECT *, """
    + _CALLOUT
    + " AS callout FROM p) WHERE callout IS NOT NULL"
)
def callout_classify(spark: SparkSession, d: str) -> DataFrame:
    # the class is made and sifted inside one expression: a filter on a column would have it made twice
    found = F.filter(F.array(classify.callout_type(F.col("raw_text"))), lambda c: c.isNotNull())
    p = _paras(spark, d).select("pos", "raw_text", F.explode(found).alias("callout"))
    return p.select("pos", "callout", text.strip_callout_prefix(F.col("raw_text")).alias("body"))


@query(_WITH + f" SELECT pos, {_CALLOUT} AS callout, {_STOP} AS stops, len(regexp_extract_all({_PLAIN}, '(?i)\\b(python|script|server|node|database|shell)\\b')) AS n_words FROM p")
def phrase_classes(spark: SparkSession, d: str) -> DataFrame:
    """Callouts, stopping points and computational words by joins with phrase tables, where the SQL has patterns."""
    callouts, stops, words = phrases.built_in(spark)
    p = _paras(spark, d).select("pos", "raw_text", text.strip_markers(F.col("raw_text")).alias("plain"))
    out = phrases.callouts(p, ["pos"], "raw_text", callouts)
    out = phrases.classes(out, ["pos"], "plain", stops, "stop").join(phrases.counts(p, ["pos"], "plain", words), "pos", "left")
    return out.select("pos", "callout", F.col("stop").isNotNull().alias("stops"), F.coalesce("n", F.lit(0)).cast("long").alias("n_words"))


@query(_WITH + f" SELECT doc_id, count(*) AS n FROM p WHERE {_STOP} GROUP BY doc_id")
def stopping_points(spark: SparkSession, d: str) -> DataFrame:
    return _paras(spark, d).where(classify.is_stopping_point(F.col("raw_text"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    r"""WITH lines AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)
 SELECT doc_id, count(*) FILTER (WHERE line = upper(replace(line, 'ß', 'SS')) AND line <> lower(line) AND len(string_split_regex(line, '\s+')) <= 8) AS n_headings, count(*) AS n_lines FROM lines WHERE line <> '' GROUP BY doc_id"""
)
def heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """Lines of `documents` that look like headings. A sharp s is no capital; the SQL writes its capital out, as its engine knows none."""
    lines = _documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line <> ''")
    return lines.groupBy("doc_id").agg(F.count_if(classify.heading_level(F.col("line"), F.lit("")) == 2).alias("n_headings"), F.count("*").alias("n_lines"))


@query(
    _WITH
    + r""", g AS (SELECT CAST(floor(pos / 8) AS BIGINT) AS part, string_agg(text, chr(10) ORDER BY pos) AS t FROM p GROUP BY 1)
 SELECT part, CASE WHEN len(regexp_extract_all(t, '(?i)\b(bash|python|git|conda|pip|docker|node|npm|script|command|terminal|shell|cli|api|server|database|bioinformatics|pipeline|workflow|jupyter|notebook|environment|package|install|deploy)\b')) >= 3 THEN 'computational' ELSE 'wet_lab' END AS section_type FROM g"""
)
def section_type(spark: SparkSession, d: str) -> DataFrame:
    p = _paras(spark, d).withColumn("part", F.floor(F.col("pos") / 8))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return p.groupBy("part").agg(joined.alias("t")).select("part", classify.section_type(F.col("t")).alias("section_type"))


_LINES = (
    _WITH
    + rf""", cells AS (SELECT doc_id, pos, row_ord, trim(regexp_replace(c1, ' {{2,}}', ' ', 'g')) AS c1, trim(regexp_replace(c2, ' {{2,}}', ' ', 'g')) AS c2 FROM ({views.TABLES_BETWEEN})),
 l AS (SELECT doc_id, pos, heading_level, is_list, list_level, -1 AS row_ord, CASE WHEN heading_level > 0 THEN repeat('#', heading_level) || ' ' WHEN is_list THEN repeat('  ', list_level - 1) || CASE WHEN is_numbered THEN list_level || '. ' ELSE '- ' END ELSE '' END || text AS line FROM lev
 UNION ALL SELECT doc_id, pos, 0, false, 0, row_ord, '| ' || c1 || ' | ' || c2 || ' |' FROM cells WHERE c1 <> '' OR c2 <> '')"""
)


def _between(spark: SparkSession, d: str) -> DataFrame:
    """The rows of tables that stand between paragraphs: a table takes the place after its paragraph, which has twice its number."""
    return views.view(spark, d, views.TABLES_BETWEEN, "events").select("doc_id", (F.col("pos") * 2 + 1).alias("pos"), "row_ord", F.array("c1", "c2").alias("cells"))


@query(_LINES + " SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY pos, row_ord)) AS text_sha256, sum(length(line)) AS n_chars, count(*) FILTER (WHERE row_ord >= 0) AS n_rows FROM l GROUP BY doc_id")
def full_text(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as plain text, with bullets, numbers, and tables between the paragraphs."""
    out = blocks.full_text(_paras(spark, d).withColumn("pos", F.col("pos") * 2), _between(spark, d))
    lines = F.split("full_text", "\n")
    n_rows = F.size(F.filter(lines, lambda x: F.startswith(x, F.lit("| ")))).cast("long")
    return out.select("doc_id", F.sha2("full_text", 256).alias("text_sha256"), (F.length("full_text") - F.size(lines) + 1).cast("long").alias("n_chars"), n_rows.alias("n_rows"))


@query(
    _LINES
    + r""", g AS (SELECT CAST(floor(pos / 6) AS BIGINT) AS part, row_ord >= 0 AS in_table, len(regexp_extract_all(line, '(?i)\b(bash|python|git|conda|pip|docker|node|npm|script|command|terminal|shell|cli|api|server|database|bioinformatics|pipeline|workflow|jupyter|notebook|environment|package|install|deploy)\b')) AS n FROM l)
 SELECT part, CASE WHEN sum(n) >= 3 THEN 'computational' ELSE 'wet_lab' END AS section_type, CASE WHEN coalesce(sum(n) FILTER (WHERE NOT in_table), 0) >= 3 THEN 'computational' ELSE 'wet_lab' END AS without_tables FROM g GROUP BY part"""
)
def document_types(spark: SparkSession, d: str) -> DataFrame:
    """The type of small documents by their whole text, and what it would be without their tables. (List levels stay below an indent of code.)"""
    part = lambda c: F.floor(c / 6).cast("long")
    p = _paras(spark, d).withColumn("doc_id", part(F.col("pos"))).withColumns({"pos": F.col("pos") * 2, "list_level": F.least("list_level", F.lit(2))})
    rows = _between(spark, d).withColumn("doc_id", part(F.floor(F.col("pos") / 2)))
    kind = classify.section_type(F.col("full_text"))
    whole = blocks.full_text(p, rows).select("doc_id", kind.alias("section_type"))
    alone = blocks.full_text(p).select("doc_id", kind.alias("without_tables"))
    return whole.join(alone, "doc_id", "left").select(F.col("doc_id").alias("part"), "section_type", F.coalesce("without_tables", F.lit("wet_lab")).alias("without_tables"))


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CASED = """array_to_string(list_transform(string_split({c}, ' '), lambda w, i: CASE WHEN upper(w) IN (%s) THEN upper(w)
 WHEN i > 1 AND i < len(string_split({c}, ' ')) AND lower(w) IN ('a', 'an', 'the', 'and', 'but', 'or', 'for', 'nor', 'on', 'at', 'to', 'by', 'in', 'of', 'up', 'as', 'is') THEN lower(w)
 ELSE upper(w[1]) || lower(w[2:]) END), '{s}')""" % _quoted(text.TITLE_ACRONYMS)
_TITLE = f"concat(lower(p_name), ' ', {views._one_of(f'p_partkey % {len(text.SLUG_ACRONYMS)}', [w.lower() for w in text.SLUG_ACRONYMS])}, CASE p_partkey % 4 WHEN 0 THEN ' of rna' WHEN 1 THEN ' for the pcr' WHEN 2 THEN ' in a tube and more words that make it longer than sixty' ELSE '' END)"


@query(f"SELECT p_partkey, {_CASED.format(c='t', s=' ')} AS title FROM (SELECT p_partkey, {_TITLE} AS t FROM part)")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, f"SELECT p_partkey, {_TITLE} AS t FROM part", "part").select("p_partkey", text.title_case(F.col("t")).alias("title"))


_SLUG = "array_to_string(list_transform(string_split(t, ' '), lambda w: CASE WHEN upper(w) IN (" + _quoted(text.SLUG_ACRONYMS) + ") THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), '-')"


@query(
    f"""WITH s AS (SELECT p_partkey, {_SLUG} AS s FROM (SELECT p_partkey, {_TITLE} AS t FROM part)),
 c AS (SELECT *, s[1:60] AS head, 60 - strpos(reverse(s[1:60]), '-') AS last FROM s)
 SELECT p_partkey, slug, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_partkey % 9 AS VARCHAR) || '-' END || slug || '_v1_' || (p_partkey % 4) || '.docx' AS output_name
 FROM (SELECT p_partkey, CASE WHEN length(s) <= 60 THEN s WHEN contains(head, '-') AND last > 20 THEN head[1:last] ELSE head END AS slug FROM c)"""
)
def output_filename(spark: SparkSession, d: str) -> DataFrame:
    t = views.view(spark, d, f"SELECT p_partkey, {_TITLE} AS t FROM part", "part")
    section = F.when(F.col("p_partkey") % 3 != 0, (F.col("p_partkey") % 9).cast("string"))
    version = F.concat(F.lit("1."), (F.col("p_partkey") % 4).cast("string"))
    return t.select("p_partkey", text.title_slug(F.col("t")).alias("slug"), text.output_filename(section, F.col("t"), version).alias("output_name"))


@query(
    r"""SELECT c_custkey, CASE WHEN t IS NULL OR trim(t) = '' OR lower(t) IN ('user', 'admin') THEN 'Unattributed' WHEN regexp_matches(t, 'customer#0*7\b', 'i') THEN 'Seven' ELSE trim(t) END AS author
 FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'User' WHEN 3 THEN concat(' ', c_name) ELSE c_name END AS t FROM customer)"""
)
def author_attribution(spark: SparkSession, d: str) -> DataFrame:
    c = views.view(spark, d, "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'User' WHEN 3 THEN concat(' ', c_name) ELSE c_name END AS t FROM customer", "customer")
    return c.select("c_custkey", text.author(F.col("t"), {r"(?i)customer#0*7\b": "Seven"}).alias("author"))


@query(
    """SELECT p_partkey, CASE WHEN length(p_name) > 15 THEN p_name || ' ' || p_name ELSE p_name END AS title,
 CASE WHEN length(p_name || ' ' || p_name) > 40 AND length(p_name) > 15 THEN (p_name || ' ' || p_name)[1:37] || '…' WHEN length(p_name) > 15 THEN p_name || ' ' || p_name ELSE p_name END AS footer,
 concat('SECTION ', p_size, ' — ', upper(p_brand), ' · Collected Procedures') AS header,
 p_brand || chr(160) || '·' || chr(160) || 'Version 1.' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(160) || '·' || chr(160) || 'Last updated 01/02/2024' END AS byline FROM part"""
)
def page_furniture(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    title = F.when(F.length("p_name") > 15, F.concat("p_name", F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    size = F.col("p_size").cast("string")
    line = text.byline(F.col("p_brand"), F.concat(F.lit("1."), size), F.when(F.col("p_partkey") % 3 != 0, "01/02/2024"))
    return p.select("p_partkey", title.alias("title"), text.footer_title(title).alias("footer"), text.header_line(size, F.col("p_brand")).alias("header"), line.alias("byline"))


# ---------------------------------------------------------------- runs and tables


@query(
    f"""WITH r AS (SELECT * FROM ({views.RUNS}) WHERE text <> ''),
 n AS (SELECT *, (SELECT count(*) FROM r b WHERE b.para_id = a.para_id AND b.run_pos <= a.run_pos AND
   coalesce((SELECT max_by((c.bold, c.italic), c.run_pos) FROM r c WHERE c.para_id = b.para_id AND c.run_pos < b.run_pos) IS DISTINCT FROM (b.bold, b.italic), true)) AS island FROM r a),
 m AS (SELECT para_id, island, any_value(bold) AS bold, any_value(italic) AS italic, string_agg(text, '' ORDER BY run_pos) AS t FROM n GROUP BY para_id, island),
 k AS (SELECT *, CASE WHEN trim(t) = '' THEN '' WHEN bold AND italic THEN '_**' WHEN bold THEN '**' WHEN italic THEN '_' ELSE '' END AS a FROM m)
 SELECT para_id, string_agg(CASE WHEN a = '' THEN t ELSE regexp_extract(t, '^ *') || a || trim(t) || reverse(a) || regexp_extract(t, ' *$') END, '' ORDER BY island) AS marked_text FROM k GROUP BY para_id"""
)
def run_merge(spark: SparkSession, d: str) -> DataFrame:
    return blocks.merge_runs(views.view(spark, d, views.RUNS, "events"))


_TROWS = f"""WITH t AS ({views.TABLES}), h AS ({views.HEADINGS}), f AS (SELECT *, first_value(n_cols) OVER (PARTITION BY doc_id, table_ord ORDER BY row_ord) AS width FROM t),
 n AS (SELECT f.*, (SELECT count(DISTINCT g.table_ord) FROM f g WHERE g.doc_id = f.doc_id AND g.table_ord < f.table_ord AND {{pick}}) AS table_no FROM f WHERE {{mine}})"""
_CELL = "CASE WHEN trim({c}) = '' THEN '—' ELSE trim({c}) END"


@query(
    _TROWS.format(pick="g.width >= 2", mine="width >= 2")
    + f""" SELECT n.doc_id, n.table_no, row_ord, coalesce(heading, 'Reagents') AS heading, {_CELL.format(c="c1")} AS cell1, {_CELL.format(c="c2")} AS cell2, CASE WHEN n_cols < 3 THEN '—' ELSE {_CELL.format(c="c3")} END AS cell3
 FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.ord = n.table_no WHERE c1 <> 'Reagent'"""
)
def materials_rows(spark: SparkSession, d: str) -> DataFrame:
    out = tables.materials(_table_rows(spark, d), _headings(spark, d))
    return out.select("doc_id", "table_no", "row_ord", "heading", *(F.get("cells", F.lit(i)).alias(f"cell{i + 1}") for i in range(3)))


@query(
    _TROWS.format(pick="g.width = 2", mine="width = 2 AND doc_id % 4 <> 1")
    + f""" SELECT n.doc_id, n.table_no, row_ord, coalesce(heading, 'Reagent Mix') AS heading, {_CELL.format(c="c1")} AS cell1, {_CELL.format(c="c2")} AS cell2, c1 LIKE 'Total%' OR c1 LIKE 'incubate%' AS bold
 FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.ord = n.table_no WHERE c1 <> 'Reagent'"""
)
def mix_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _table_rows(spark, d)
    out = tables.mixes(rows, _headings(spark, d), rows.where("doc_id % 4 <> 1"))
    return out.select("doc_id", "table_no", "row_ord", "heading", F.get("cells", F.lit(0)).alias("cell1"), F.get("cells", F.lit(1)).alias("cell2"), "bold")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, list_filter(list_transform(string_split(line, ' | '), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE contains(line, ' | '))
 SELECT doc_id, count(*) AS n_rows, sum(len(cells)) AS n_cells, max(len(cells)) AS widest FROM c WHERE len(cells) > 0 GROUP BY doc_id"""
)
def pipe_table_scan(spark: SparkSession, d: str) -> DataFrame:
    lines = _documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.contains("line", F.lit(" | ")))
    rows = blocks.table_rows(lines.select("doc_id", F.split("line", r" \| ").alias("cells"))).withColumn("n", F.size(F.filter("cells", lambda c: F.length(c) > 0)).cast("long"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_cells"), F.max("n").alias("widest"))



@query(
    """WITH nums AS (SELECT p_partkey AS doc_id, p_size AS num_id, p_size % 4 AS abstract_id FROM part), abs AS (SELECT p_partkey AS doc_id, 1 AS abstract_id, 0 AS ilvl, 'bullet' AS fmt FROM part UNION ALL SELECT p_partkey, 2, 1, 'decimal' FROM part UNION ALL SELECT p_partkey, 3, 0, NULL FROM part)
 SELECT n.doc_id, n.num_id, coalesce(a.ilvl, 0) AS ilvl, coalesce(a.fmt <> 'bullet', true) AS numbered FROM nums n LEFT JOIN abs a ON a.doc_id = n.doc_id AND a.abstract_id = n.abstract_id"""
)
def numbered_lists(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("num_id"), (F.col("p_size") % 4).alias("abstract_id"))
    a = p.select("doc_id", F.explode(F.expr("array(named_struct('a', 1, 'l', 0, 'f', 'bullet'), named_struct('a', 2, 'l', 1, 'f', 'decimal'), named_struct('a', 3, 'l', 0, 'f', cast(null as string)))")).alias("s"))
    return blocks.numbered_lists(p, a.select("doc_id", F.col("s.a").alias("abstract_id"), F.col("s.l").alias("ilvl"), F.col("s.f").alias("fmt")))


# ---------------------------------------------------------------- segments, sections, steps


@query(_WITH + " SELECT doc_id, segment, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM seg GROUP BY ALL")
def segment_roles(spark: SparkSession, d: str) -> DataFrame:
    return _segmented(spark, d).groupBy("doc_id", "segment").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(_PROC + " SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, any_value(heading) AS heading, count(*) FILTER (WHERE kind = 'step') AS n_steps, count(*) FILTER (WHERE kind = 'callout') AS n_callouts, max(text) FILTER (WHERE kind = 'preamble') AS preamble FROM sections GROUP BY ALL")
def procedure_sections(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d)
    return s.groupBy("doc_id", "section_no").agg(F.first("heading").alias("heading"), F.count_if(F.col("kind") == "step").alias("n_steps"), F.count_if(F.col("kind") == "callout").alias("n_callouts"), F.max(F.when(F.col("kind") == "preamble", F.col("text"))).alias("preamble"))


@query(_TREE + " SELECT doc_id, pos, CAST(section_no AS BIGINT) AS section_no, CAST(seq AS BIGINT) AS seq, depth, CAST(parent_seq AS BIGINT) AS parent_seq, rendered FROM tree")
def step_tree(spark: SparkSession, d: str) -> DataFrame:
    out = segment.step_tree(_sections(spark, d))
    return out.select("doc_id", "pos", "section_no", F.col("seq").cast("long").alias("seq"), "depth", F.col("parent_seq").cast("long").alias("parent_seq"), "rendered")


@query(_TREE + " SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(seq AS BIGINT) AS seq, CASE depth WHEN 0 THEN 'decimal' WHEN 1 THEN 'lower_letter' WHEN 2 THEN 'lower_roman' ELSE CASE WHEN doc_id % 2 = 0 THEN 'none' ELSE 'bullet' END END AS number_style, row_number() OVER (PARTITION BY doc_id, depth ORDER BY pos) AS ordinal FROM tree WHERE kind = 'step' AND rendered")
def step_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of steps; every other document counts as computational, where deep steps have none."""
    out = segment.step_numbers(segment.step_tree(_sections(spark, d)), F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "section_no", F.col("seq").cast("long").alias("seq"), "number_style", F.col("ordinal").cast("long").alias("ordinal"))


#: All events as the paragraphs of four documents, so that each grows with the table; the blocks of the queries are small, so that small tables have many.
_GIANT_PARA = views.PARA.replace("SELECT user_id AS doc_id", "SELECT CAST(event_id % 4 AS BIGINT) AS doc_id")
_GIANT_BLOCK = 512


def _giant(spark: SparkSession, d: str) -> DataFrame:
    return giants.segments(blocks.paragraphs(views.view(spark, d, _GIANT_PARA, "events")), _GIANT_BLOCK)


@query(_WITH.replace(views.PARA, _GIANT_PARA) + " SELECT doc_id, segment, class, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(pos) AS BIGINT) AS positions FROM seg GROUP BY ALL")
def giant_segments(spark: SparkSession, d: str) -> DataFrame:
    """Roles and classes of the paragraphs of giant documents, by blocks and carries."""
    return _giant(spark, d).groupBy("doc_id", "segment", "class").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("pos").alias("positions"))


@query(_TREE.replace(views.PARA, _GIANT_PARA) + " SELECT doc_id, pos, CAST(section_no AS BIGINT) AS section_no, CAST(seq AS BIGINT) AS seq, depth, CAST(parent_seq AS BIGINT) AS parent_seq, rendered FROM tree")
def giant_step_tree(spark: SparkSession, d: str) -> DataFrame:
    """Steps of giant documents, nested by min-plus carries."""
    out = giants.step_tree(giants.procedure(_giant(spark, d), _GIANT_BLOCK), _GIANT_BLOCK)
    return out.select("doc_id", "pos", "section_no", F.col("seq").cast("long").alias("seq"), "depth", F.col("parent_seq").cast("long").alias("parent_seq"), "rendered")


@query(_TREE.replace(views.PARA, _GIANT_PARA) + " SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, CAST(seq AS BIGINT) AS seq, CASE depth WHEN 0 THEN 'decimal' WHEN 1 THEN 'lower_letter' WHEN 2 THEN 'lower_roman' ELSE 'bullet' END AS number_style, row_number() OVER (PARTITION BY doc_id, depth ORDER BY pos) AS ordinal FROM tree WHERE kind = 'step' AND rendered")
def giant_step_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of steps that run through giant documents."""
    tree = giants.step_tree(giants.procedure(_giant(spark, d), _GIANT_BLOCK), _GIANT_BLOCK)
    return giants.step_numbers(tree, _GIANT_BLOCK).select("doc_id", "section_no", F.col("seq").cast("long").alias("seq"), "number_style", F.col("ordinal").cast("long").alias("ordinal"))


_FOOT = "SELECT c_custkey AS doc_id, k.id, concat('Footnote ', k.id, ' of ', c_name) AS text FROM customer CROSS JOIN (SELECT 3 AS id UNION ALL SELECT 1 UNION ALL SELECT 0) k"


@query(_WITH + f", f AS ({_FOOT}), a AS (SELECT doc_id, 0 AS part, pos AS place, text AS note FROM seg WHERE segment = 'notes' AND (is_list OR heading_level = 0) UNION ALL SELECT doc_id, 1, id, text FROM f WHERE id > 0) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, place) AS number, note FROM a")
def notes_and_footnotes(spark: SparkSession, d: str) -> DataFrame:
    out = segment.notes(_segmented(spark, d), views.view(spark, d, _FOOT, "customer"))
    return out.select("doc_id", F.col("number").cast("long").alias("number"), "note")


@query(_WITH + " SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, text AS reference FROM seg WHERE segment = 'references' AND heading_level = 0")
def references(spark: SparkSession, d: str) -> DataFrame:
    out = segment.references(_segmented(spark, d))
    return out.select("doc_id", F.col("number").cast("long").alias("number"), "reference")


@query(
    _WITH
    + f""", said AS (SELECT * FROM seg WHERE segment IN ('overview', 'pre_overview')), pick AS (SELECT doc_id, CASE WHEN bool_or(segment = 'overview') THEN 'overview' ELSE 'pre_overview' END AS segment FROM said GROUP BY doc_id),
 main AS (SELECT doc_id, trim(string_agg(text, chr(10) || chr(10) ORDER BY pos), ' ' || chr(10)) AS t FROM said JOIN pick USING (doc_id, segment) WHERE heading_level = 0 AND NOT is_list AND NOT {_STOP} AND length(raw_text) > 20 GROUP BY doc_id),
 early AS (SELECT doc_id, min_by(text, pos) AS t FROM lev l WHERE heading_level = 0 AND NOT is_list AND NOT {_STOP} AND length(raw_text) > 40 AND pos < coalesce((SELECT min(pos) FROM lev i WHERE i.doc_id = l.doc_id AND i.is_list), 9223372036854775807) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(CASE WHEN main.t <> '' THEN main.t END, early.t, '') AS overview FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN main USING (doc_id) LEFT JOIN early USING (doc_id)"""
)
def overview_text(spark: SparkSession, d: str) -> DataFrame:
    return segment.overview(_paras(spark, d))


_PRE = """SELECT event_id AS pos, user_id AS doc_id, 0 AS heading_level, 'prerequisites' AS segment,
 CASE event_id % 5 WHEN 0 THEN concat('Software: tool ', event_id % 7) WHEN 1 THEN concat('ACCESS : node ', event_id % 3) WHEN 2 THEN concat('Dependencies: lib', event_id % 4) WHEN 3 THEN 'depends gcc' ELSE 'other text' END AS raw_text FROM events"""


@query(
    rf"""WITH p AS ({_PRE}) SELECT doc_id, regexp_replace(max_by(raw_text, pos) FILTER (WHERE lower(raw_text) LIKE 'software%'), '^software[:\s]+', '', 'i') AS software,
 regexp_replace(max_by(raw_text, pos) FILTER (WHERE lower(raw_text) LIKE 'access%'), '^access[:\s]+', '', 'i') AS access, regexp_replace(max_by(raw_text, pos) FILTER (WHERE lower(raw_text) LIKE 'depend%'), '^depend\w*[:\s]+', '', 'i') AS dependencies FROM p GROUP BY doc_id"""
)
def prerequisites(spark: SparkSession, d: str) -> DataFrame:
    return segment.prerequisites(views.view(spark, d, _PRE, "events"))


@query(_WITH + " SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (WHERE heading_level > 0) AS n_headings, count(*) FILTER (WHERE is_list) AS n_items, count(*) FILTER (WHERE class LIKE 'callout%') AS n_callouts FROM lev GROUP BY doc_id")
def document_counts(spark: SparkSession, d: str) -> DataFrame:
    p = _paras(spark, d)
    return p.groupBy("doc_id").agg(F.count("*").alias("n_paragraphs"), F.count_if(F.col("heading_level") > 0).alias("n_headings"), F.count_if("is_list").alias("n_items"), F.count_if(classify.callout_type(F.col("raw_text")).isNotNull()).alias("n_callouts"))


@query(_WITH + r", t AS (SELECT doc_id, min_by(raw_text, pos) AS t FROM lev WHERE heading_level = 1 GROUP BY doc_id) SELECT d.doc_id, coalesce(t.t, concat('Document ', d.doc_id)) AS title FROM (SELECT DISTINCT doc_id FROM p) d LEFT JOIN t USING (doc_id)")
def titles(spark: SparkSession, d: str) -> DataFrame:
    """The first first-level heading, cleaned, else the file name's stem in title case."""
    p = _paras(spark, d)
    out = p.groupBy("doc_id").agg(F.min_by("raw_text", F.when(F.col("heading_level") == 1, F.col("pos"))).alias("t"))
    return out.select("doc_id", F.coalesce(F.when(F.col("t").isNotNull(), text.clean_title(F.col("t"))), text.stem_title(F.concat(F.lit("/in/document_"), F.col("doc_id").cast("string"), F.lit(".docx")))).alias("title"))


_REGISTRY = {str(i): f"Part {i}" for i in range(1, 10)}


@query("SELECT payload_id, CASE WHEN n_sections BETWEEN 1 AND 5 THEN CAST(n_sections AS VARCHAR) WHEN n_sections = 6 THEN '66' WHEN has_prereq THEN '9' ELSE '' END AS section_number, CASE WHEN n_sections BETWEEN 1 AND 5 THEN concat('Part ', n_sections) WHEN has_prereq THEN 'Part 9' ELSE '' END AS section_name FROM (" + views.PAYLOADS + ")")
def section_names(spark: SparkSession, d: str) -> DataFrame:
    """The hinted section, with its name if the registry has it; else the computational default, else none."""
    p = views.view(spark, d, views.PAYLOADS, "orders")
    hint = F.when(F.col("n_sections").between(1, 5), F.col("n_sections").cast("string")).when(F.col("n_sections") == 6, "66")
    place = registry.section(hint, F.col("has_prereq"), _REGISTRY)
    return p.select("payload_id", place.alias("s")).select("payload_id", F.col("s.number").alias("section_number"), F.col("s.name").alias("section_name"))


# ---------------------------------------------------------------- rendering


def _callouts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, tree, callouts): every third callout stays at the section's top, the others follow the step before them."""
    from pyspark.sql import Window

    sections = _sections(spark, d)
    tree = segment.step_tree(sections)
    w = Window.partitionBy("doc_id", "section_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    top = tree.where("depth = 0").select("doc_id", "section_no", "pos", F.lit(1).alias("is_top"), F.lit(None).cast("string").alias("class"), F.lit(None).cast("string").alias("text"))
    calls = sections.where("kind = 'callout'").select("doc_id", "section_no", "pos", F.lit(0).alias("is_top"), "class", "text")
    both = top.unionByName(calls).withColumn("before", F.sum("is_top").over(w))
    after = F.when((F.col("pos") % 3 != 0) & (F.col("before") > 0), F.col("before") - 1)
    callouts = both.where("is_top = 0").select("doc_id", "section_no", F.col("pos").alias("ord"), F.substring("class", 9, 20).alias("callout_type"), text.strip_callout_prefix(F.col("text")).alias("text"), after.alias("after_step"))
    return sections, tree, callouts


_PLACED = _TREE + r""", tops AS (SELECT doc_id, section_no, pos, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) - 1 AS nth FROM tree WHERE depth = 0), calls AS (
 SELECT doc_id, section_no, pos AS ord, class[9:] AS callout_type, trim(regexp_replace(text, '^(important|warning|caution|note|tip|critical|crucial)\s*[:\-–—]\s*', '', 'i')) AS text,
  CASE WHEN pos % 3 <> 0 THEN (SELECT max(t.pos) FROM tops t WHERE t.doc_id = s.doc_id AND t.section_no = s.section_no AND t.pos < s.pos) END AS step_pos FROM sections s WHERE kind = 'callout')"""


@query(_PLACED + " SELECT c.doc_id, CAST(c.section_no AS BIGINT) AS section_no, c.ord, c.callout_type, CAST(t.nth AS BIGINT) AS after_step, c.step_pos FROM calls c LEFT JOIN tops t ON t.doc_id = c.doc_id AND t.section_no = c.section_no AND t.pos = c.step_pos")
def callout_placement(spark: SparkSession, d: str) -> DataFrame:
    _, tree, callouts = _callouts(spark, d)
    return render.place_callouts(tree, callouts).select("doc_id", "section_no", "ord", "callout_type", F.col("after_step").cast("long").alias("after_step"), "step_pos")


@query(
    _PLACED
    + """, heads AS (SELECT doc_id, section_no, any_value(heading) AS heading, max(text) FILTER (WHERE kind = 'preamble') AS preamble FROM sections GROUP BY ALL), roots AS (
 SELECT t.*, (SELECT max(r.pos) FROM tops r WHERE r.doc_id = t.doc_id AND r.section_no = t.section_no AND r.pos <= t.pos) AS root_pos FROM tree t), rows AS (
 SELECT DISTINCT doc_id, -1 AS s, 0 AS a, 0 AS b, 0 AS c, 'heading1' AS kind, 'Procedure' AS body FROM heads UNION ALL SELECT DISTINCT doc_id, -1, 0, 0, 1, 'spacer', '' FROM heads
 UNION ALL SELECT doc_id, section_no, -3, 0, 0, 'heading2', heading FROM heads UNION ALL SELECT doc_id, section_no, -2, 0, 0, 'paragraph', preamble FROM heads WHERE preamble IS NOT NULL
 UNION ALL SELECT doc_id, section_no, coalesce(step_pos, -1), CASE WHEN step_pos IS NULL THEN 0 ELSE 1 END, 2 * ord + k.k, CASE k.k WHEN 0 THEN 'callout_' || callout_type ELSE 'spacer' END, CASE k.k WHEN 0 THEN CASE callout_type WHEN 'critical' THEN '⚠' || repeat(chr(160), 2) || 'CRITICAL' WHEN 'caution' THEN '⚠' || repeat(chr(160), 2) || 'Caution' WHEN 'tip' THEN '💡' || repeat(chr(160), 2) || 'Tip' ELSE 'ℹ' || repeat(chr(160), 2) || 'Note' END || chr(10) || text ELSE '' END FROM calls, (SELECT 0 AS k UNION ALL SELECT 1) k
 UNION ALL SELECT doc_id, section_no, root_pos, 0, pos, CASE WHEN kind = 'stopping_point' THEN kind ELSE 'step' || depth END, CASE WHEN kind = 'stopping_point' THEN '⏸' || repeat(chr(160), 2) || 'Safe stopping point' || chr(160) || '—' || chr(160) ELSE '' END || text FROM roots WHERE rendered
 UNION ALL SELECT doc_id, section_no, 4611686018427387904, 0, 0, 'spacer', '' FROM heads)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, a, b, c, kind, body) AS block_no, kind, body FROM rows"""
)
def render_blocks(spark: SparkSession, d: str) -> DataFrame:
    made = folder.procedures(*_callouts(spark, d))
    blocks = made.select("doc_id", F.posexplode(render.procedure_blocks(F.col("procedure"))).alias("block_no", "b"))
    return blocks.select("doc_id", (F.col("block_no") + 1).cast("long").alias("block_no"), "b.kind", "b.body")


@query(
    _WITH
    + """, r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, text FROM seg WHERE segment = 'references' AND heading_level = 0)
 SELECT DISTINCT doc_id, 1 AS block_no, 'heading1' AS kind, 'References' AS body FROM r UNION ALL SELECT DISTINCT doc_id, 2, 'spacer', '' FROM r UNION ALL SELECT doc_id, n + 2, 'reference', text FROM r"""
)
def reference_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _list_blocks(folder.listed(segment.references(_segmented(spark, d)), "number", "reference", "items"), render.reference_blocks)


def _list_blocks(items: DataFrame, blocks) -> DataFrame:  # noqa: ANN001  a function of the column `items`
    out = items.select("doc_id", F.posexplode(blocks(F.col("items"))).alias("block_no", "b"))
    return out.select("doc_id", (F.col("block_no") + 1).cast("long").alias("block_no"), "b.kind", "b.body")


@query(
    _WITH
    + f""", f AS ({_FOOT}), a AS (SELECT doc_id, 0 AS part, pos AS place, text AS note FROM seg WHERE segment = 'notes' AND (is_list OR heading_level = 0) UNION ALL SELECT doc_id, 1, id, text FROM f WHERE id > 0),
 r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, place) AS n, note FROM a)
 SELECT DISTINCT doc_id, 1 AS block_no, 'heading1' AS kind, 'Notes & Variants' AS body FROM r UNION ALL SELECT DISTINCT doc_id, 2, 'spacer', '' FROM r UNION ALL SELECT doc_id, n + 2, 'note', n || '.' || repeat(chr(160), 2) || note FROM r"""
)
def note_blocks(spark: SparkSession, d: str) -> DataFrame:
    notes = segment.notes(_segmented(spark, d), views.view(spark, d, _FOOT, "customer"))
    return _list_blocks(folder.listed(notes, "number", "note", "items"), render.note_blocks)


# ---------------------------------------------------------------- records


_POST = f"""WITH q AS ({views.PAYLOADS}), r AS (SELECT payload_id, title, has_prereq, n_materials, n_mix, n_sections, n_cells, n_steps, CASE WHEN section_type = '' THEN 'wet_lab' ELSE lower(trim(section_type)) END AS section_type,
 {_DATE.format(c="date_raw")} AS date, CASE WHEN coalesce(author_raw, '') = '' THEN 'Unattributed' ELSE author_raw END AS author, CASE after_step_raw WHEN '2' THEN 2 WHEN '-1' THEN -1 END AS after_step FROM q)"""


@query(_POST + " SELECT payload_id, section_type, date, author, after_step FROM r")
def post_process(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("payload_id", "section_type", "date", "author", "after_step")


@query(
    _POST
    + """ SELECT payload_id, 'title_empty' AS rule, '' AS detail FROM r WHERE title = '' UNION ALL SELECT payload_id, 'type_unknown', section_type FROM r WHERE section_type NOT IN ('wet_lab', 'computational')
 UNION ALL SELECT payload_id, 'date_invalid', date FROM r WHERE CAST(date[4:5] AS INT) NOT BETWEEN 1 AND 12 OR CAST(date[1:2] AS INT) NOT BETWEEN 1 AND 31
 UNION ALL SELECT payload_id, 'prerequisites_in_wet_lab', '' FROM r WHERE section_type = 'wet_lab' AND has_prereq
 UNION ALL SELECT payload_id, 'materials_in_computational', CAST(n_materials AS VARCHAR) FROM r WHERE section_type = 'computational' AND n_materials > 0
 UNION ALL SELECT payload_id, 'mixes_in_computational', CAST(n_mix AS VARCHAR) FROM r WHERE section_type = 'computational' AND n_mix > 0
 UNION ALL SELECT payload_id, 'procedure_empty', '' FROM r WHERE n_sections = 0 UNION ALL SELECT payload_id, 'materials_width', CAST(n_cells AS VARCHAR) FROM r WHERE n_materials > 0 AND n_cells <> 3
 UNION ALL SELECT payload_id, 'mix_width', CAST(n_cells AS VARCHAR) FROM r WHERE n_mix > 0 AND n_cells <> 2 UNION ALL SELECT payload_id, 'after_step_range', CAST(after_step AS VARCHAR) FROM r WHERE NOT (after_step BETWEEN 0 AND n_steps - 1)"""
)
def violations(spark: SparkSession, d: str) -> DataFrame:
    return validate.violations(_payloads(spark, d))


@query(
    _POST
    + """ SELECT payload_id, CASE WHEN title = '' THEN 'title' WHEN section_type NOT IN ('wet_lab', 'computational') THEN 'section_type' WHEN n_sections = 0 THEN 'procedure'
 WHEN section_type = 'wet_lab' AND has_prereq THEN 'prerequisites' WHEN section_type = 'computational' AND n_materials + n_mix > 0 THEN 'materials' END AS error FROM r"""
)
def first_render_error(spark: SparkSession, d: str) -> DataFrame:
    return validate.first_render_error(_payloads(spark, d))


# ---------------------------------------------------------------- batches


_DUP = f"WITH f AS ({views.FILES}), d AS (SELECT *, row_number() OVER (PARTITION BY lower(list_last(string_split(path, '/'))) ORDER BY string_split(path, '/')) > 1 AS dup FROM f)"


@query(f"SELECT path, lower(regexp_extract(path, '\\.[^.]*$')) AS suffix FROM ({views.FILES}) WHERE path LIKE '%.docx' OR path LIKE '%.doc'")
def batch_sources(spark: SparkSession, d: str) -> DataFrame:
    return batch.sources(_files(spark, d)).select("path", F.lower(F.regexp_extract("path", r"\.[^.]*$", 0)).alias("suffix"))


@query(_DUP + " SELECT path, dup AS duplicate FROM d")
def duplicate_files(spark: SparkSession, d: str) -> DataFrame:
    return batch.duplicates(_files(spark, d)).select("path", "duplicate")


@query(_DUP + " SELECT CASE WHEN dup THEN 'skipped' WHEN lower(path) LIKE '%.docx' THEN 'success' ELSE 'failed' END AS status, count(*) AS n FROM d GROUP BY ALL")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return batch.summary(batch.outcomes(_files(spark, d)))


@query("SELECT o, count(*) > 1 AS collides, count(*) AS n FROM (SELECT concat(p_brand, '_v', p_size % 3, '.docx') AS o FROM part) GROUP BY o")
def output_collisions(spark: SparkSession, d: str) -> DataFrame:
    names = spark.read.parquet(f"{d}/part.parquet").select(F.concat("p_brand", F.lit("_v"), (F.col("p_size") % 3).cast("string"), F.lit(".docx")).alias("output_name"))
    return batch.output_collisions(names).groupBy(F.col("output_name").alias("o")).agg(F.bool_or("collides").alias("collides"), F.count("*").alias("n"))


# ---------------------------------------------------------------- completion


@query(
    """SELECT doc_id, attempt, CASE k WHEN 0 THEN '{"title": "T' || doc_id || '", ' || p || '}' WHEN 1 THEN '{"title": "A {b} ' || doc_id || '", "d": {"e": 1}, ' || p || '}' WHEN 4 THEN '{"title": "", ' || p || '}' WHEN 5 THEN '{bad json}' WHEN 6 THEN '{"title": "T", "procedure": []}' END AS object,
 CASE k WHEN 2 THEN 'no_json' WHEN 3 THEN 'incomplete' WHEN 4 THEN 'validation_error' WHEN 5 THEN 'parse_error' WHEN 6 THEN 'validation_error' END AS failure_kind,
 CASE k WHEN 4 THEN 'title_empty title' WHEN 6 THEN 'procedure_empty procedure' ELSE '' END AS detail
 FROM (SELECT s_suppkey AS doc_id, a AS attempt, (s_suppkey * 3 + a * 5) % 7 AS k, '"procedure": [{"heading": "H", "steps": [], "callouts": []}]' AS p FROM supplier, (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4))"""
)
def json_from_response(spark: SparkSession, d: str) -> DataFrame:
    return _attempts(spark, d).select("doc_id", "attempt", "object", "failure_kind", "detail")


@query(
    """WITH k AS (SELECT s_suppkey AS doc_id, a AS attempt, (s_suppkey * 3 + a * 5) % 7 AS k FROM supplier, (SELECT 1 AS a UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)),
 v AS (SELECT doc_id, min(attempt) AS attempt FROM k WHERE k IN (0, 1) GROUP BY doc_id)
 SELECT s.s_suppkey AS doc_id, v.attempt, CASE k.k WHEN 0 THEN 'T' || s.s_suppkey WHEN 1 THEN 'A {b} ' || s.s_suppkey END AS title, CASE WHEN v.attempt IS NULL THEN 'heuristic' ELSE 'completion' END AS source
 FROM supplier s LEFT JOIN v ON v.doc_id = s.s_suppkey LEFT JOIN k ON k.doc_id = v.doc_id AND k.attempt = v.attempt"""
)
def first_valid_attempt(spark: SparkSession, d: str) -> DataFrame:
    return completion.first_valid(_attempts(spark, d)).drop("object")


_USER = "'" + completion.conventions().replace("'", "''") + "' || chr(10) || chr(10) || 'File: ' || doc_id || '.docx' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'Type: wet_lab' || chr(10) || chr(10) ELSE '' END || trim(text, ' ' || chr(9) || chr(10)) || chr(10) || chr(10) || '" + completion.TASK + "'"


def _messages(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d)
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".docx"))
    return docs.select("doc_id", completion.user_message(F.col("text"), name, None, F.when(F.col("doc_id") % 2 == 0, "wet_lab")).alias("user_message"))


@query(f"SELECT doc_id, length(u) AS n_chars, sha256(u) AS message_sha256 FROM (SELECT doc_id, {_USER} AS u FROM documents)")
def prompt_messages(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("doc_id", F.length("user_message").cast("long").alias("n_chars"), F.sha2("user_message", 256).alias("message_sha256"))


@query(f"SELECT doc_id, CAST(greatest(1, floor(length(u) / 3.5)) AS BIGINT) + {max(1, int(len(completion.SYSTEM) / 3.5))} AS total, greatest(1, floor(length(u) / 3.5)) + {max(1, int(len(completion.SYSTEM) / 3.5))} > 24576 AS over FROM (SELECT doc_id, {_USER} AS u FROM documents)")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("b", completion.token_budget(F.col("user_message")))
    return m.select("doc_id", F.col("b.total").alias("total"), F.col("b.over").alias("over"))


# ---------------------------------------------------------------- small functions


@query("SELECT doc_id, CASE WHEN form IN (0, 3, 4, 5) THEN strftime(o_orderdate, '%d/%m/%Y') WHEN form IN (1, 2) THEN strftime(o_orderdate, '01/%m/%Y') END AS date FROM (" + views.DATES + ")")
def dates_in_words(spark: SparkSession, d: str) -> DataFrame:
    """Dates as people write them; the SQL knows the day that was written."""
    return views.view(spark, d, views.DATES, "orders").select("doc_id", text.normalize_date(F.col("text")).alias("date"))


_SAID = "SELECT p_partkey AS doc_id, concat('Add 5 mL. ', p_name, ' is here! Use approx. ', p_size, ' tubes, e.g. Falcon? Yes. no end… “', p_brand, '” it’s 1–2 ') AS text FROM part"


@query(f"SELECT doc_id, unnest(['Add 5 mL. ' || p_name || ' is here!', 'Use approx. ' || p_size || ' tubes, e.g. Falcon?', 'Yes. no end… “' || p_brand || '” it’s 1–2 ']) AS sentence, unnest([0, 1, 2]) AS n FROM (SELECT p_partkey AS doc_id, * FROM part)")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, _SAID, "part").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("n", "sentence"))


@query(f"SELECT doc_id, trim(text) AS kept, trim(replace(replace(replace(replace(replace(replace(text, '“', chr(34)), '”', chr(34)), '’', chr(39)), '‘', chr(39)), '–', '-'), '…', '...')) AS plain FROM ({_SAID})")
def plain_punctuation(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, _SAID, "part").select("doc_id", text.normalize_text(F.col("text")).alias("kept"), text.normalize_text(F.col("text"), False).alias("plain"))


_CODED = "SELECT p_partkey AS doc_id, concat('Run `make **', p_size, '**` in _', p_brand, '_ and **wait** ', p_name, CASE WHEN p_partkey % 3 = 0 THEN ' ` open' ELSE '' END) AS text, concat('cd ', p_name, chr(10), CASE WHEN p_partkey % 2 = 0 THEN chr(13) ELSE '' END, chr(10), 'ls') AS code, CASE p_partkey % 4 WHEN 0 THEN 'bash' WHEN 1 THEN '' END AS code_language FROM part"


@query(
    f"""WITH p AS ({_CODED}), t AS (SELECT doc_id, unnest([{{'text': 'Run ', 'code': false, 'bold': false, 'italic': false}}, {{'text': 'make **' || p_size || '**', 'code': true, 'bold': false, 'italic': false}}, {{'text': ' in ', 'code': false, 'bold': false, 'italic': false}},
 {{'text': p_brand, 'code': false, 'bold': false, 'italic': true}}, {{'text': ' and ', 'code': false, 'bold': false, 'italic': false}}, {{'text': 'wait', 'code': false, 'bold': true, 'italic': false}}, {{'text': ' ' || p_name || CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE '' END, 'code': false, 'bold': false, 'italic': false}},
 CASE WHEN doc_id % 3 = 0 THEN {{'text': '`', 'code': false, 'bold': false, 'italic': false}} END, CASE WHEN doc_id % 3 = 0 THEN {{'text': ' open', 'code': false, 'bold': false, 'italic': false}} END]) AS t, unnest(range(9)) AS n FROM p JOIN part ON p_partkey = doc_id)
 SELECT doc_id, CAST(n AS INT) AS n, t.text AS text, t.bold AS bold, t.italic AS italic, t.code AS code FROM t WHERE t IS NOT NULL"""
)
def code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, _CODED, "part").select("doc_id", F.posexplode(text.inline_code_tokens(F.col("text"))).alias("n", "t")).select("doc_id", "n", "t.text", "t.bold", "t.italic", "t.code")


@query(f"SELECT doc_id, CASE WHEN coalesce(code_language, '') = '' THEN '' ELSE '# ' || code_language || '|' END || 'cd ' || p_name || '| |ls' AS lines FROM ({_CODED}) JOIN part ON p_partkey = doc_id")
def code_lines(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, _CODED, "part").select("doc_id", F.array_join(text.code_lines(F.col("code"), F.col("code_language")), "|").alias("lines"))


_INFO = "SELECT o_orderkey AS doc_id, o_orderkey % 5 <> 0 AS has_properties, o_orderkey % 3 <> 0 AS has_numbering, CAST(o_orderkey % 4 AS INT) AS num_id, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderkey % 7 AS INT) END AS ilvl, CASE o_orderkey % 2 WHEN 0 THEN 'List Number' ELSE CASE o_orderkey % 11 WHEN 3 THEN 'List Bullet' ELSE 'Normal' END END AS style, CASE o_orderkey % 13 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END AS numbered FROM orders"


@query(
    f"""SELECT doc_id, CASE WHEN NOT has_properties THEN false WHEN NOT has_numbering THEN style LIKE 'List%' ELSE num_id > 0 END AS is_list,
 CAST(CASE WHEN NOT has_properties OR (has_numbering AND num_id = 0) OR (NOT has_numbering AND style NOT LIKE 'List%') THEN 0 WHEN NOT has_numbering THEN 1 ELSE coalesce(ilvl, 0) + 1 END AS INT) AS level,
 CASE WHEN NOT has_properties OR (has_numbering AND num_id = 0) THEN false WHEN NOT has_numbering THEN style = 'List Number' ELSE coalesce(numbered, true) END AS numbered FROM ({_INFO})"""
)
def list_info(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, _INFO, "orders")
    return rows.select("doc_id", blocks.list_info(*(F.col(c) for c in ("has_properties", "has_numbering", "num_id", "ilvl", "style", "numbered"))).alias("i")).select("doc_id", "i.*")


_SHOWN = "SELECT event_id AS ord, CASE event_id % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'caution' WHEN 2 THEN 'tip' WHEN 3 THEN 'note' WHEN 4 THEN 'hint' END AS callout_type FROM events"


@query(f"SELECT ord, callout_type, CASE callout_type WHEN 'tip' THEN '💡' WHEN 'note' THEN 'ℹ' ELSE '⚠' END AS symbol, CASE callout_type WHEN 'critical' THEN upper(callout_type) ELSE upper(callout_type[1]) || callout_type[2:] END AS label, NULL AS problem FROM ({_SHOWN}) WHERE callout_type <> 'hint' UNION ALL SELECT ord, callout_type, NULL, NULL, 'unknown' FROM ({_SHOWN}) WHERE coalesce(callout_type, 'hint') = 'hint'")
def callout_presentation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.view(spark, d, _SHOWN, "events")
    null = lambda name: F.lit(None).cast("string").alias(name)
    known = render.presentation(rows).select("ord", "callout_type", "symbol", "label", null("problem"))
    return known.unionByName(render.unknown_callouts(rows).select("ord", "callout_type", null("symbol"), null("label"), F.lit("unknown").alias("problem")))


_EDIT = """SELECT p_partkey AS doc_id, concat('{"title": "', p_name, '", "procedure": [{"heading": "H"}]}') AS document, CASE p_partkey % 6 WHEN 0 THEN 'title' WHEN 1 THEN 'procedure[0].heading' WHEN 2 THEN 'procedure[2].heading' WHEN 3 THEN 'none.x' WHEN 4 THEN 'title[0]' ELSE '..' END AS path,
 CASE WHEN p_partkey % 4 = 0 THEN '7' ELSE p_brand END AS value FROM part"""


@query(
    f"""SELECT doc_id, CASE p WHEN 0 THEN v ELSE title END AS title, CASE p WHEN 1 THEN v WHEN 0 THEN 'H' END AS heading, p IN (0, 1) AS done FROM (SELECT doc_id, doc_id % 6 AS p, value AS v, CASE WHEN doc_id % 6 = 1 THEN json_extract_string(document, '$.title') END AS title FROM ({_EDIT}))"""
)
def json_edits(spark: SparkSession, d: str) -> DataFrame:
    """Values set at nested paths, which count from 0; paths that lead nowhere change nothing and are said."""
    rows = views.view(spark, d, _EDIT, "part").select("doc_id", set_json_path(F.col("document"), F.col("path"), F.col("value")).alias("e"))
    at = lambda *path: F.when(F.col("e.document").isNotNull(), completion.nested(F.col("e.document"), *path))
    return rows.select("doc_id", at("title").alias("title"), F.get_json_object("e.document", "$.procedure[0].heading").alias("heading"), F.col("e.problem").isNull().alias("done"))


@query("SELECT doc_id, length(m) AS n_chars, sha256(m) AS message_sha256 FROM (SELECT doc_id, 'The answer was not valid:' || chr(10) || chr(10) || 'title_empty' || chr(10) || chr(10) || 'It was:' || chr(10) || chr(10) || CASE WHEN length(text) > 2000 THEN text[1:2000] || chr(10) || '[cut]' ELSE text END || chr(10) || chr(10) || '" + completion.TASK + "' AS m FROM documents)")
def retry_messages(spark: SparkSession, d: str) -> DataFrame:
    m = _documents(spark, d).select("doc_id", completion.retry_message(F.col("text"), F.lit("title_empty")).alias("m"))
    return m.select("doc_id", F.length("m").cast("long").alias("n_chars"), F.sha2("m", 256).alias("message_sha256"))


@query(f"SELECT c_custkey AS doc_id, 'm' AS model, 'system, user' AS roles, c_name AS said, false AS stream, 'json' AS format, CAST(0.1 AS DOUBLE) AS temperature, 4096 AS most_tokens, {len(completion.SYSTEM)} AS n_system FROM customer")
def completion_requests(spark: SparkSession, d: str) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    body = completion.request("m", completion.messages(F.col("c_name")))
    shape = "model string, messages array<struct<role: string, content: string>>, stream boolean, format string, options struct<temperature: double, num_predict: int>"
    r = c.select(F.col("c_custkey").alias("doc_id"), F.from_json(body, shape).alias("r"))
    return r.select("doc_id", "r.model", F.array_join("r.messages.role", ", ").alias("roles"), F.col("r.messages")[1]["content"].alias("said"), "r.stream", "r.format", F.col("r.options.temperature").alias("temperature"), F.col("r.options.num_predict").alias("most_tokens"), F.length(F.col("r.messages")[0]["content"]).alias("n_system"))


# ---------------------------------------------------------------- records as JSON


def _json_records(spark: SparkSession, d: str, sql: str) -> DataFrame:
    return views.view(spark, d, sql, "orders").withColumn("record", F.from_json("json", records.RECORD))


_RULES = f"""WITH b AS ({views.BROKEN}), p AS (SELECT doc_id, doc_id % 13 <> 0 AS fine, doc_id % 9 AS q, doc_id % 9 NOT IN (0, 1, 2) AS whole, doc_id % 5 AS f FROM b), k AS (SELECT *, CASE f WHEN 0 THEN 'computational' WHEN 1 THEN 'odd' ELSE 'wet_lab' END AS t, doc_id % 11 IN (0, 1) AS m FROM p WHERE fine)"""


@query(
    _RULES
    + """ SELECT doc_id, 'not_json' AS rule, '' AS path FROM p WHERE NOT fine
 UNION ALL SELECT doc_id, 'title_empty', 'title' FROM k WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'title_missing', 'title' FROM k WHERE doc_id % 7 = 1
 UNION ALL SELECT doc_id, 'title_mistyped', 'title' FROM k WHERE doc_id % 7 = 2 UNION ALL SELECT doc_id, 'section_number_missing', 'section_number' FROM k WHERE doc_id % 6 = 1 UNION ALL SELECT doc_id, 'overview_missing', 'overview' FROM k WHERE doc_id % 8 = 3 UNION ALL SELECT doc_id, 'overview_mistyped', 'overview' FROM k WHERE doc_id % 8 = 4
 UNION ALL SELECT doc_id, 'type_unknown', 'section_type' FROM k WHERE t = 'odd' UNION ALL SELECT doc_id, 'date_invalid', 'date' FROM k WHERE doc_id % 4 IN (1, 2)
 UNION ALL SELECT doc_id, 'prerequisites_in_wet_lab', 'prerequisites' FROM k WHERE t = 'wet_lab' AND doc_id % 3 = 0
 UNION ALL SELECT doc_id, 'materials_in_computational', 'materials' FROM k WHERE t = 'computational' AND m UNION ALL SELECT doc_id, 'mixes_in_computational', 'mix_tables' FROM k WHERE t = 'computational' AND doc_id % 11 = 1
 UNION ALL SELECT doc_id, 'materials_width', 'materials[0].rows[0].cells' FROM k WHERE doc_id % 11 = 0 UNION ALL SELECT doc_id, 'mix_width', 'mix_tables[0].rows[0].cells' FROM k WHERE doc_id % 11 = 1
 UNION ALL SELECT doc_id, 'materials_width', 'materials[1].rows[' || r || '].cells' FROM k, (VALUES (1), (3)) w(r) WHERE doc_id % 11 IN (0, 1) AND doc_id % 2 = 0
 UNION ALL SELECT doc_id, 'rows_empty', 'materials[2].rows' FROM k WHERE doc_id % 11 IN (0, 1) AND doc_id % 2 = 0
 UNION ALL SELECT doc_id, 'notes_mistyped', CASE WHEN doc_id % 10 = 3 THEN 'notes' ELSE 'notes[1]' END FROM k WHERE doc_id % 10 IN (3, 4)
 UNION ALL SELECT doc_id, 'procedure_empty', 'procedure' FROM k WHERE q = 0 UNION ALL SELECT doc_id, 'procedure_missing', 'procedure' FROM k WHERE q = 1 UNION ALL SELECT doc_id, 'procedure_mistyped', 'procedure' FROM k WHERE q = 2
 UNION ALL SELECT doc_id, 'heading_empty', 'procedure[1].heading' FROM k WHERE whole AND doc_id % 4 = 0 UNION ALL SELECT doc_id, 'step_text_empty', 'procedure[1].steps[0].text' FROM k WHERE whole AND doc_id % 3 = 2 UNION ALL SELECT doc_id, 'step_type_unknown', 'procedure[1].steps[0].step_type' FROM k WHERE whole AND f = 3
 UNION ALL SELECT doc_id, 'callout_type_unknown', 'procedure[1].callouts[0].callout_type' FROM k WHERE whole AND doc_id % 7 = 5 UNION ALL SELECT doc_id, 'callout_text_empty', 'procedure[1].callouts[0].text' FROM k WHERE whole AND doc_id % 7 = 6 UNION ALL SELECT doc_id, 'after_step_range', 'procedure[1].callouts[0].after_step' FROM k WHERE whole AND f IN (0, 2)"""
)
def record_violations(spark: SparkSession, d: str) -> DataFrame:
    return records.violations(_json_records(spark, d, views.BROKEN))


def _processed(spark: SparkSession, d: str) -> DataFrame:
    return views.view(spark, d, views.RECORDS, "orders").select("doc_id", records.post_processed(F.col("json")).alias("record"))


_GOOD = """WITH g AS (SELECT o_orderkey AS k, *, o_orderkey % 4 = 0 AS comp, o_orderkey % 4 <> 0 AND o_orderkey % 3 > 0 AS has_m, o_orderkey % 4 <> 0 AND o_orderkey % 5 > 2 AS has_x FROM orders)"""


@query(
    _GOOD
    + """ SELECT k AS doc_id, CASE WHEN k % 5 = 0 THEN 'Unattributed' ELSE 'Team ' || o_custkey END AS author, CASE WHEN k % 6 = 0 THEN '2.1' ELSE '1.0' END AS version, CASE WHEN comp THEN 'computational' ELSE 'wet_lab' END AS section_type,
 CASE k % 3 WHEN 0 THEN strftime(o_orderdate, '01/%m/%Y') WHEN 1 THEN '07/08/2021' END AS date, 'use ice' AS callout, CASE k % 3 WHEN 1 THEN 0 WHEN 2 THEN 1 END AS after_step,
 CASE WHEN has_m THEN 'NaCl,—,x' || (k % 9) || ',false;KCl,—,—,true' ELSE '' END AS materials, CASE WHEN has_x THEN 'Salt,1 g,false;Total,2 g,true' ELSE '' END AS mixes FROM g"""
)
def record_post_process(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("record")
    call = r["procedure"][0]["callouts"][0]
    rows = lambda t: F.array_join(F.flatten(F.transform(t, lambda x: F.transform(x["rows"], lambda y: F.concat_ws(",", y["cells"], y["bold"].cast("string"))))), ";")
    out = _processed(spark, d)
    return out.select("doc_id", *(r[c].alias(c) for c in ("author", "version", "section_type", "date")), call["text"].alias("callout"), call["after_step"].cast("int").alias("after_step"), rows(r["materials"]).alias("materials"), rows(r["mix_tables"]).alias("mixes"))


@query(_GOOD + " SELECT k AS doc_id, 1 AS n_sections, CASE WHEN k % 3 = 1 THEN 2 ELSE 0 END AS n_notes, CASE WHEN k % 4 = 2 THEN 1 ELSE 0 END AS n_references, has_m::INT AS n_materials, has_x::INT AS n_mixes, 4 AS n_steps, 1 AS n_callouts FROM g")
def record_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.counts(_processed(spark, d)).select("doc_id", *(F.col(c).cast("int") for c in ("n_sections", "n_notes", "n_references", "n_materials", "n_mixes", "n_steps", "n_callouts")))


_NB = "chr(160)"
_TITLED = "'Protocol ' || k || CASE WHEN k % 5 = 0 THEN ' with a title that is longer than what a footer holds' ELSE '' END"
_BLOCKS = (
    _GOOD
    + f""", t AS (SELECT *, {_TITLED} AS title, CASE WHEN comp THEN 'code_step' ELSE 'step' END AS s, CASE k % 3 WHEN 0 THEN strftime(o_orderdate, '01/%m/%Y') WHEN 1 THEN '07/08/2021' END AS date, CASE WHEN k % 6 = 0 THEN '2.1' ELSE '1.0' END AS version FROM g), b AS (
 SELECT k, 1 AS a, 'page_header' AS kind, concat('SECTION ', k % 8, ' — NAME ', k % 8, ' · Collected Procedures') AS body, NULL::VARCHAR[] AS cells FROM t
 UNION ALL SELECT k, 2, 'page_footer', CASE WHEN length(title) > 40 THEN title[1:37] || '…' ELSE title END || chr(9) || 'Version ' || version || chr(9), NULL FROM t UNION ALL SELECT k, 3, 'title', title, NULL FROM t
 UNION ALL SELECT k, 4, 'subtitle', 'Part ' || (k % 5), NULL FROM t WHERE k % 3 = 0
 UNION ALL SELECT k, 5, 'byline', CASE WHEN k % 5 = 0 THEN 'Unattributed' ELSE 'Team ' || o_custkey END || {_NB} || '·' || {_NB} || 'Version ' || version || CASE WHEN date IS NULL THEN '' ELSE {_NB} || '·' || {_NB} || 'Last updated ' || date END, NULL FROM t
 UNION ALL SELECT k, 6, 'spacer', '', NULL FROM t UNION ALL SELECT k, 7, 'heading1', 'Overview', NULL FROM t UNION ALL SELECT k, 8, 'spacer', '', NULL FROM t UNION ALL SELECT k, 9, 'paragraph', 'First ' || (k % 7), NULL FROM t UNION ALL SELECT k, 10, 'paragraph', 'Second', NULL FROM t WHERE k % 2 = 0
 UNION ALL SELECT k, 11, 'heading1', 'Prerequisites', NULL FROM t WHERE comp UNION ALL SELECT k, 12, 'spacer', '', NULL FROM t WHERE comp UNION ALL SELECT k, 13, 'field', 'Software:' || {_NB} || 'git', NULL FROM t WHERE comp UNION ALL SELECT k, 14, 'field', 'Dependencies:' || {_NB} || 'numpy', NULL FROM t WHERE comp UNION ALL SELECT k, 15, 'spacer', '', NULL FROM t WHERE comp
 UNION ALL SELECT k, 16 + i, x.kind, x.body, x.cells FROM (SELECT k, unnest([{{'kind': 'heading1', 'body': 'Materials', 'cells': NULL::VARCHAR[]}}, {{'kind': 'spacer', 'body': '', 'cells': NULL}}, {{'kind': 'heading3', 'body': 'Salts', 'cells': NULL}}, {{'kind': 'material_header', 'body': '', 'cells': ['Reagent / Equipment', 'Supplier', 'Cat. No. / Notes']}},
   {{'kind': 'material', 'body': '', 'cells': ['NaCl', '—', 'x' || (k % 9)]}}, {{'kind': 'material_bold', 'body': '', 'cells': ['KCl', '—', '—']}}, {{'kind': 'spacer', 'body': '', 'cells': NULL}}]) AS x, unnest(range(7)) AS i FROM t WHERE has_m)
 UNION ALL SELECT k, 30 + i, x.kind, x.body, NULL FROM (SELECT k, unnest([{{'kind': 'heading1', 'body': 'Procedure'}}, {{'kind': 'spacer', 'body': ''}}, {{'kind': 'heading2', 'body': 'Prepare'}}, CASE WHEN k % 2 = 0 THEN {{'kind': 'paragraph', 'body': 'Read all.'}} END,
   CASE WHEN k % 3 = 0 THEN {{'kind': 'callout_tip', 'body': '💡' || repeat(chr(160), 2) || 'Tip' || chr(10) || 'use ice'}} END, CASE WHEN k % 3 = 0 THEN {{'kind': 'spacer', 'body': ''}} END, {{'kind': s || '0', 'body': 'Run `make`'}},
   CASE WHEN comp THEN {{'kind': 'code', 'body': '# bash' || chr(10) || 'make' || chr(10) || ' ' || chr(10) || 'ls'}} END, CASE WHEN comp THEN {{'kind': 'spacer', 'body': ''}} END, {{'kind': s || '1', 'body': 'Wait ' || (k % 11)}},
   CASE WHEN k % 3 = 1 THEN {{'kind': 'callout_tip', 'body': '💡' || repeat(chr(160), 2) || 'Tip' || chr(10) || 'use ice'}} END, CASE WHEN k % 3 = 1 THEN {{'kind': 'spacer', 'body': ''}} END,
   {{'kind': 'stopping_point', 'body': '⏸' || repeat(chr(160), 2) || 'Safe stopping point' || chr(160) || '—' || chr(160) || 'Can be stored'}},
   CASE WHEN k % 3 = 2 THEN {{'kind': 'callout_tip', 'body': '💡' || repeat(chr(160), 2) || 'Tip' || chr(10) || 'use ice'}} END, CASE WHEN k % 3 = 2 THEN {{'kind': 'spacer', 'body': ''}} END, {{'kind': 'spacer', 'body': ''}}]) AS x, unnest(range(16)) AS i FROM t) WHERE x IS NOT NULL
 UNION ALL SELECT k, 50 + i, x.kind, x.body, NULL FROM (SELECT k, unnest([{{'kind': 'heading1', 'body': 'Notes & Variants'}}, {{'kind': 'spacer', 'body': ''}}, {{'kind': 'note', 'body': '1.' || repeat(chr(160), 2) || 'one'}}, {{'kind': 'note', 'body': '2.' || repeat(chr(160), 2) || 'two'}}]) AS x, unnest(range(4)) AS i FROM t WHERE k % 3 = 1)
 UNION ALL SELECT k, 60, 'heading1', 'References', NULL FROM t WHERE k % 4 = 2 UNION ALL SELECT k, 61, 'spacer', '', NULL FROM t WHERE k % 4 = 2 UNION ALL SELECT k, 62, 'reference', 'A book', NULL FROM t WHERE k % 4 = 2
 UNION ALL SELECT k, 70 + i, x.kind, x.body, x.cells FROM (SELECT k, unnest([{{'kind': 'heading1', 'body': 'Reagent Mixes & Recipes', 'cells': NULL::VARCHAR[]}}, {{'kind': 'spacer', 'body': '', 'cells': NULL}}, {{'kind': 'heading3', 'body': 'Mix', 'cells': NULL}}, {{'kind': 'mix_header', 'body': '', 'cells': ['Component', 'Amount']}},
   {{'kind': 'mix', 'body': '', 'cells': ['Salt', '1 g']}}, {{'kind': 'mix_bold', 'body': '', 'cells': ['Total', '2 g']}}, {{'kind': 'spacer', 'body': '', 'cells': NULL}}]) AS x, unnest(range(7)) AS i FROM t WHERE has_x)
 UNION ALL SELECT k, 80, 'spacer', '', NULL FROM t UNION ALL SELECT k, 81, 'end', '───  End of Protocol  ───', NULL FROM t)"""
)


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return render.plan(_processed(spark, d).withColumn("output_name", F.concat(F.col("doc_id").cast("string"), F.lit(".docx"))))


@query(_BLOCKS + " SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY a) AS block_no, kind, body, array_to_string(cells, '|') AS cells FROM b")
def document_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of whole records, wet and computational."""
    return _plan(spark, d).select("doc_id", F.col("block_no").cast("long").alias("block_no"), "kind", "body", F.array_join("cells", "|").alias("cells"))


# ---------------------------------------------------------------- Word files


def _dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt to all tasks before each becomes a file: a table may be one file of one row group."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def _read(packed: DataFrame) -> DataFrame:
    """The blocks that are read from files as bytes."""
    return ooxml.read_bytes(packed.select(F.col("doc_id").alias("path"), "content")).withColumn("doc_id", F.col("path").cast("long"))


@query(
    _BLOCKS
    + """ SELECT k AS doc_id, count(*) FILTER (WHERE kind NOT LIKE 'page_%' AND kind NOT LIKE 'callout_%' AND kind <> 'code' AND cells IS NULL) AS n_paragraphs, count(*) FILTER (WHERE kind LIKE 'callout_%' OR kind = 'code' OR kind LIKE '%_header' AND kind <> 'page_header') AS n_tables,
 coalesce(string_agg(array_to_string(cells, '|'), ';' ORDER BY a) FILTER (WHERE cells IS NOT NULL), '') AS rows, count(*) FILTER (WHERE kind LIKE 'step%' OR kind LIKE 'code_step%') AS n_items,
 string_agg(CASE WHEN kind = 'code_step0' THEN 'Run make' ELSE body END, '|' ORDER BY a) FILTER (WHERE kind LIKE 'heading%' OR kind LIKE 'step%' OR kind LIKE 'code_step%' OR kind = 'title') AS said FROM b GROUP BY k"""
)
def rendered_files(spark: SparkSession, d: str) -> DataFrame:
    """Records rendered, written as Word files and read again: paragraphs, tables, list items, headings."""
    made = records.post_processed(F.col("json"))
    whole = _dealt(views.view(spark, d, views.RECORDS, "orders")).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("output_name"), made.alias("record"))
    rows = _read(ooxml.pack(render.whole(whole)))
    plain = F.array_join(F.transform("runs", lambda r: r["text"]), "")
    shown = F.col("has_numbering") | F.col("style_name").isin("Title", "Heading 1", "Heading 2", "Heading 3")
    data = F.when((F.col("kind") == "table") & (F.size(F.col("cells")[0]) > 1), F.array_join(F.transform("cells", lambda c: F.array_join(c, "|")), ";"))
    ordered = lambda c, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("pos"), c.alias("x"))))), lambda s: s["x"]), sep)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"), F.count_if(F.col("kind") == "table").alias("n_tables"), ordered(data, ";").alias("rows"), F.count_if("has_numbering").alias("n_items"), ordered(F.when(shown, plain), "|").alias("said"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    """The procedural view as Word files: doc_id, content."""
    para = views.view(spark, d, views.PARA, "events")
    kind = F.when(F.startswith("style_name", F.lit("Heading")), F.concat(F.lit("heading"), F.substring("style_name", 9, 1))).when(F.col("list_level") > 0, F.concat(F.lit("step"), (F.col("list_level") - 1).cast("string"))).otherwise("paragraph")
    return ooxml.pack_documents(para.select("doc_id", F.concat(F.lit("document_"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("output_name"), F.col("pos").alias("block_no"), kind.alias("kind"), F.col("text").alias("body")))


_RAW = _PLAIN.replace("raw_text", "text")


@query(
    f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, CASE WHEN style_name LIKE 'Heading%' THEN style_name ELSE 'Normal' END AS style_name, {_RAW} AS text, list_level > 0 AS is_list, list_level AS level, list_level BETWEEN 1 AND 3 AS numbered FROM ({views.PARA})"
)
def word_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs read from Word files: order, styles, texts, numbering."""
    rows = _read(_words(spark, d)).where("kind = 'paragraph'")
    info = blocks.list_info(*(F.col(c) for c in ("has_properties", "has_numbering", "num_id", "ilvl", "style_name", "numbered")))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "style_name", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), info.alias("i")).select("doc_id", "pos", "style_name", "text", "i.is_list", "i.level", "i.numbered")


@query(
    f"""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, regexp_extract_all(text, '_\\*\\*.+?\\*\\*_|\\*\\*.+?\\*\\*|_.+?_|[^*_]+|[*_]') AS ts FROM ({views.PARA})), t AS (SELECT doc_id, pos, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS run_no FROM p)
 SELECT doc_id, pos, run_no, CASE WHEN t LIKE '**%' AND length(t) > 4 THEN t[3:-3] WHEN t[1] = '_' AND length(t) > 2 THEN t[2:-2] ELSE t END AS text, t LIKE '**%' AND length(t) > 4 AS bold, t[1] = '_' AND length(t) > 2 AS italic FROM t"""
)
def word_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs and their formats, read from Word files."""
    rows = _read(_words(spark, d)).where("kind = 'paragraph'").select("doc_id", "pos", F.posexplode("runs").alias("run_no", "r"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("run_no").cast("long").alias("run_no"), "r.text", "r.bold", "r.italic")


@query(
    f"""WITH t AS ({views.TABLES}), c AS (SELECT doc_id, table_ord, row_ord, list_transform([c1, c2, c3][1:n_cols], lambda x: trim(x)) AS cells FROM t), n AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY table_ord) - 1 AS pos FROM c)
 SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id, pos ORDER BY row_ord) - 1 AS row_no, array_to_string(cells, '|') AS cells FROM n WHERE len(list_filter(cells, lambda x: x <> '')) > 0"""
)
def word_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables and their cells, read from Word files."""
    kind = F.when(F.col("row_ord") == 0, "material_header").otherwise("material")
    rows = _table_rows(spark, d).select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("output_name"), (F.col("table_ord") * 1000 + F.col("row_ord")).alias("block_no"), kind.alias("kind"), F.lit("").alias("body"), "cells")
    found = _read(ooxml.pack_documents(rows)).where("kind = 'table'").select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode("cells").alias("row_no", "c"))
    return found.select("doc_id", "pos", F.col("row_no").cast("long").alias("row_no"), F.array_join("c", "|").alias("cells"))


_OWNED = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN '' ELSE concat('  Title   ', o_orderkey) END AS title, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Admin' ELSE concat('Clerk ', o_custkey) END AS creator, o_orderdate FROM orders"


@query(f"SELECT doc_id, CASE WHEN title <> '' THEN 'Title ' || doc_id END AS title, CASE doc_id % 3 WHEN 2 THEN creator ELSE 'Unattributed' END AS author, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate + INTERVAL 1 DAY, '%d/%m/%Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date FROM ({_OWNED})")
def word_properties(spark: SparkSession, d: str) -> DataFrame:
    """Title, author and last date, read from Word files."""
    o = _dealt(views.view(spark, d, _OWNED, "orders"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made, changed = F.when(F.col("doc_id") % 5 > 0, stamp(F.col("o_orderdate"))), F.when(F.col("doc_id") % 5 == 1, stamp(F.date_add("o_orderdate", 1)))
    rows = F.array(*(render.block(f"property_{n}", c) for n, c in (("title", F.col("title")), ("creator", F.col("creator")), ("created", made), ("modified", changed))), render.block("paragraph", "x"))
    packed = ooxml.pack(o.select("doc_id", F.lit("x.docx").alias("output_name"), rows.alias("blocks")))
    return _read(packed).where("kind = 'properties'").select("doc_id", "title", text.author(F.col("author")).alias("author"), "date")


@query(f"SELECT doc_id, CAST(id AS INT) AS id, text FROM ({_FOOT}) WHERE id > 0")
def word_footnotes(spark: SparkSession, d: str) -> DataFrame:
    """Footnotes read from Word files; the numbers below 1 are the format's own."""
    notes = views.view(spark, d, _FOOT, "customer")
    packed = ooxml.pack_documents(notes.select("doc_id", F.lit("x.docx").alias("output_name"), F.col("id").alias("block_no"), F.concat(F.lit("footnote_"), F.col("id").cast("string")).alias("kind"), F.replace("text", F.lit(" "), F.lit("  ")).alias("body")))
    return _read(packed).where("kind = 'footnote'").select("doc_id", F.col("footnote_id").alias("id"), F.col("runs")[0]["text"].alias("text"))


@query("SELECT doc_id, sha256(text) AS content_hash, first_doc, doc_id <> first_doc AS repeats FROM (SELECT doc_id, text, coalesce(CASE WHEN text IS NOT NULL THEN min(doc_id) OVER (PARTITION BY text) END, doc_id) AS first_doc FROM documents)")
def content_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content an earlier one has, by its hash."""
    docs = _documents(spark, d).select("doc_id", manifest.content_hash(F.col("text")).alias("content_hash"))
    return manifest.repeats(docs, "doc_id").select("doc_id", "content_hash", F.col("first_path").alias("first_doc"), (F.col("doc_id") != F.col("first_path")).alias("repeats"))


def _sql(spark: SparkSession, d: str, statement: str, *tables: str) -> DataFrame:
    sqlfunctions.register(spark)
    return views.view(spark, d, statement, *tables)


@query(_SQL["stopping_points"])
def sql_stopping_points(spark: SparkSession, d: str) -> DataFrame:
    """As stopping_points, in SQL alone."""
    return _sql(spark, d, f"SELECT doc_id, count(*) AS n FROM ({views.PARA}) WHERE is_stopping_point(squeeze(text)) GROUP BY doc_id", "events")


@query(_SQL["segment_classes"])
def sql_segment_classes(spark: SparkSession, d: str) -> DataFrame:
    """As segment_classes, in SQL alone: roles by a window, classes by functions."""
    statement = f"""WITH p AS (SELECT *, squeeze(text) AS raw FROM ({views.PARA})), h AS (SELECT *, heading_level(raw, style_name) AS level FROM p WHERE raw <> ''),
      s AS (SELECT *, coalesce(last_value(CASE WHEN level = 1 THEN section_role(raw) END) IGNORE NULLS OVER (PARTITION BY doc_id ORDER BY pos), 'pre_overview') AS segment FROM h)
      SELECT segment, paragraph_class(raw, contains(lower(style_name), 'list')) AS class, count(*) AS n FROM s WHERE level <> 1 GROUP BY ALL"""
    return _sql(spark, d, statement, "events")


@query(_SQL["heading_levels"])
def sql_heading_levels(spark: SparkSession, d: str) -> DataFrame:
    """As heading_levels, in SQL alone."""
    statement = "SELECT doc_id, count_if(heading_level(line, '') = 2) AS n_headings, count(*) AS n_lines FROM (SELECT doc_id, lines_of(text) AS of FROM documents), LATERAL inline(of) GROUP BY doc_id"
    return _sql(spark, d, statement, "documents")


@query(_SQL["pipe_table_scan"])
def sql_pipe_table_scan(spark: SparkSession, d: str) -> DataFrame:
    """As pipe_table_scan, in SQL alone."""
    statement = """WITH l AS (SELECT doc_id, cells_of(line) AS cells FROM (SELECT doc_id, lines_of(text) AS of FROM documents), LATERAL inline(of) WHERE contains(line, ' | ')),
      c AS (SELECT doc_id, CAST(size(filter(cells, c -> c.cell <> '')) AS BIGINT) AS n FROM l)
      SELECT doc_id, count(*) AS n_rows, sum(n) AS n_cells, max(n) AS widest FROM c WHERE n > 0 GROUP BY doc_id"""
    return _sql(spark, d, statement, "documents")


@query(_SQL["content_repeats"])
def sql_content_repeats(spark: SparkSession, d: str) -> DataFrame:
    """As content_repeats, in SQL alone."""
    statement = """WITH h AS (SELECT doc_id, content_hash(text) AS content_hash FROM documents), f AS (SELECT content_hash, min(doc_id) AS first_doc FROM h WHERE content_hash IS NOT NULL GROUP BY content_hash)
      SELECT doc_id, content_hash, coalesce(first_doc, doc_id) AS first_doc, doc_id <> coalesce(first_doc, doc_id) AS repeats FROM h LEFT JOIN f USING (content_hash)"""
    return _sql(spark, d, statement, "documents")


@query(f"SELECT path, CASE WHEN lower(path) LIKE '%.docx' THEN CASE WHEN file_id % 3 = 0 THEN 'BadZipFile' ELSE 'read' END WHEN path LIKE '%.doc' THEN 'no converter' ELSE 'unsupported type' END AS outcome FROM ({views.FILES})")
def files_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Files read by their type; what can't be read is a row with its reason."""
    from quire.sources.docx import document_bytes

    whole = F.lit(document_bytes([("paragraph", "x")]))
    files = _files(spark, d).select("path", F.when(F.col("file_id") % 3 == 0, F.lit(b"no zip")).otherwise(whole).alias("content"))
    rows = ooxml.read_files(files).where("kind in ('error', 'paragraph')")
    return rows.select("path", F.coalesce(F.regexp_extract("problem", "^([^:]+)", 1), F.lit("read")).alias("outcome"))


@query(
    _TREE
    + r""", docs AS (SELECT DISTINCT doc_id FROM p), heads AS (SELECT doc_id, min_by(raw_text, pos) AS t FROM lev WHERE heading_level = 1 GROUP BY doc_id),
 kind AS (SELECT doc_id, bool_or(is_list AND heading_level = 0 AND list_level > 2) OR sum(len(regexp_extract_all(text, '(?i)\b(python|script|server)\b'))) >= 3 AS comp FROM lev GROUP BY doc_id),
 sec AS (SELECT doc_id, count(DISTINCT section_no) AS n FROM sections GROUP BY doc_id), st AS (SELECT doc_id, count(*) AS n FROM tree GROUP BY doc_id), ca AS (SELECT doc_id, count(*) AS n FROM sections WHERE kind = 'callout' GROUP BY doc_id),
 items AS (SELECT doc_id, count(*) AS n FROM lev WHERE is_list AND heading_level = 0 GROUP BY doc_id),
 no AS (SELECT doc_id, count(*) AS n FROM seg WHERE segment = 'notes' AND (is_list OR heading_level = 0) GROUP BY doc_id), re AS (SELECT doc_id, count(*) AS n FROM seg WHERE segment = 'references' AND heading_level = 0 GROUP BY doc_id)
 SELECT d.doc_id, coalesce(heads.t, 'Document ' || d.doc_id) AS title, CASE WHEN comp THEN 'computational' ELSE 'wet_lab' END AS section_type, CASE WHEN comp THEN '9' ELSE '' END AS section_number, CASE WHEN comp THEN 'Part 9' ELSE '' END AS section_name,
  coalesce(sec.n, 1) AS n_sections, CASE WHEN sec.n IS NULL THEN greatest(coalesce(items.n, 0), 1) ELSE coalesce(st.n, 0) END AS n_steps, coalesce(ca.n, 0) AS n_callouts, coalesce(no.n, 0) AS n_notes, coalesce(re.n, 0) AS n_references
 FROM docs d LEFT JOIN heads USING (doc_id) LEFT JOIN kind USING (doc_id) LEFT JOIN sec USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN ca USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN no USING (doc_id) LEFT JOIN re USING (doc_id)"""
)
def records_from_files(spark: SparkSession, d: str) -> DataFrame:
    """From the bytes of Word files to records: title, type, section, counts of the parts."""
    files = _words(spark, d).select(F.concat(F.lit("/in/"), "output_name").alias("path"), "content")
    rows = folder.record_rows(folder.Folder(spark, files=files, sections_registry=_REGISTRY)).withColumn("doc_id", F.regexp_extract("doc_id", r"(\d+)\.docx$", 1).cast("long"))
    heads = (F.col(f"record.{c}").alias(c) for c in ("title", "section_type", "section_number", "section_name"))
    return records.counts(rows, *heads).select("doc_id", "title", "section_type", "section_number", "section_name", "n_sections", "n_steps", "n_callouts", "n_notes", "n_references")


@query(
    f"""WITH p AS (SELECT doc_id, count(*) AS n FROM ({views.PARA}) GROUP BY 1), t AS (SELECT doc_id, count(DISTINCT table_ord) AS n FROM ({views.TABLES}) GROUP BY 1), f AS (SELECT doc_id, count(*) AS n FROM ({_FOOT}) WHERE id > 0 GROUP BY 1)
 SELECT doc_id, coalesce(p.n, 0) AS n_paragraphs, coalesce(t.n, 0) AS n_tables, coalesce(f.n, 0) AS n_footnotes FROM p FULL JOIN t USING (doc_id) FULL JOIN f USING (doc_id)"""
)
def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, tables and footnotes of Word files that have some of each."""
    name = F.lit("x.docx").alias("output_name")
    none = F.lit(None).cast("array<string>").alias("cells")
    kind = F.when(F.col("row_ord") == 0, "material_header").otherwise("material").alias("kind")
    para = views.view(spark, d, views.PARA, "events").select("doc_id", name, F.col("pos").alias("block_no"), F.lit("paragraph").alias("kind"), F.col("text").alias("body"), none)
    rows = _table_rows(spark, d).select("doc_id", name, (F.col("table_ord") * 1000 + F.col("row_ord") - 1_000_000).alias("block_no"), kind, F.lit("").alias("body"), "cells")
    foot = views.view(spark, d, _FOOT, "customer").select("doc_id", name, F.lit(-2_000_000).cast("long").alias("block_no"), F.concat(F.lit("footnote_"), F.col("id").cast("string")).alias("kind"), F.col("text").alias("body"), none)
    return blocks.counts(_read(ooxml.pack_documents(para.unionByName(rows).unionByName(foot))))


@query(_GOOD + " SELECT k AS doc_id, 16 AS n_keys, k % 3 <> 0 AS no_subtitle, k % 3 = 2 AS no_date, '\"depth\":1,\"parent_seq\":null' AS step FROM g")
def record_json(spark: SparkSession, d: str) -> DataFrame:
    """Records written as JSON: every field is there, null or not."""
    out = _processed(spark, d).select("doc_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("j"))
    return out.select("doc_id", F.size(F.json_object_keys("j")).alias("n_keys"), F.contains("j", F.lit('"subtitle":null')).alias("no_subtitle"), F.contains("j", F.lit('"date":null')).alias("no_date"), F.regexp_extract("j", '"depth":1,"parent_seq":null', 0).alias("step"))


def _replay(bodies: list[str]) -> list[completion.Reply]:
    """Replies by a rule: the question says after how many bad answers a good one comes."""
    import json

    out: list[completion.Reply] = []
    for body in bodies:
        turns = json.loads(body)["messages"]
        tries, wanted = (len(turns) - 2) // 2, int(turns[1]["content"])
        if tries >= wanted:
            out.append(('{"title": "T", "procedure": [{"heading": "H", "steps": []}]}', None))
        else:
            out.append([("none", None), ('{"title": "T", "procedure": []}', None), (None, "not_json: <html>"), ("{", None)][tries])
    return out


@query(
    _GOOD
    + """, k AS (SELECT s_suppkey AS k, a AS attempt, (s_suppkey * 3 + a * 5) % 7 AS c FROM supplier, (VALUES (1), (2), (3), (4)) t(a)), v AS (SELECT k, min(attempt) AS attempt, min_by(c, attempt) AS c FROM k WHERE c IN (0, 1) GROUP BY k)
 SELECT k AS doc_id, CASE WHEN attempt IS NOT NULL THEN 'completion' WHEN o_orderkey IS NOT NULL THEN 'heuristic' ELSE 'none' END AS source, attempt, CASE c WHEN 0 THEN 'T' || k WHEN 1 THEN 'A {b} ' || k ELSE 'Protocol ' || k || CASE WHEN k % 5 = 0 THEN ' with a title that is longer than what a footer holds' ELSE '' END END AS title,
 CASE WHEN attempt IS NOT NULL THEN 0 ELSE 4 END AS n_steps FROM (SELECT * FROM g FULL JOIN v USING (k))"""
)
def records_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    """A record a document: of the first valid attempt, else the heuristic's."""
    out = completion.with_fallback(_attempts(spark, d), _processed(spark, d))
    n = records.counts(out)
    return out.select("doc_id", "source", "attempt", "record.title").join(n.select("doc_id", "n_steps"), "doc_id")


@query(
    _GOOD
    + f""", e AS ({views.EDITS}), first AS (SELECT k, comp, has_m, has_x, NOT (comp OR has_m OR has_x) AS at_once FROM g),
 said AS (SELECT e.doc_id, n, path, CASE n WHEN 1 THEN CASE WHEN NOT comp AND (has_m OR has_x) THEN concat_ws('; ', CASE WHEN has_m THEN 'materials_in_computational materials' END, CASE WHEN has_x THEN 'mixes_in_computational mix_tables' END) END
  WHEN 2 THEN CASE WHEN doc_id % 3 = 0 THEN 'title_empty title' END WHEN 3 THEN CASE WHEN doc_id % 5 = 0 THEN 'wrong type' END
  WHEN 5 THEN CASE WHEN doc_id % 4 > 1 THEN 'after_step_range procedure[0].callouts[0].after_step' END
  WHEN 7 THEN CASE WHEN NOT comp AND (has_m AND NOT emptied OR has_x AND NOT mixed) THEN concat_ws('; ', CASE WHEN has_m AND NOT emptied THEN 'materials_in_computational materials' END, CASE WHEN has_x AND NOT mixed THEN 'mixes_in_computational mix_tables' END) END END AS reason
  FROM e JOIN first ON k = doc_id JOIN (SELECT doc_id, bool_or(n = 4) AS emptied, bool_or(n = 6) AS mixed FROM e GROUP BY 1) m USING (doc_id)),
 last AS (SELECT doc_id, bool_or(n IN (1, 7) AND reason IS NULL) AS made, bool_or(n = 2 AND reason IS NULL) AS titled FROM said GROUP BY 1)
 SELECT doc_id, n, path, reason IS NULL AS accepted, reason, CASE WHEN comp OR made THEN 'computational' ELSE 'wet_lab' END AS final_type, CASE WHEN titled THEN 'Edited ' || doc_id ELSE g.title END AS final_title
 FROM said JOIN last USING (doc_id) JOIN (SELECT k, comp, 'Protocol ' || k || CASE WHEN k % 5 = 0 THEN ' with a title that is longer than what a footer holds' ELSE '' END AS title FROM g) g ON g.k = doc_id"""
)
def record_edits(spark: SparkSession, d: str) -> DataFrame:
    """Edits folded over records in their order, each accepted or rolled back, and what the records are in the end."""
    out = review.folded(_processed(spark, d), views.view(spark, d, views.EDITS, "lineitem"))
    rows = out.select("doc_id", F.explode("results").alias("e"), F.col("record.section_type").alias("final_type"), F.col("record.title").alias("final_title"))
    return rows.select("doc_id", "e.n", "e.path", "e.accepted", "e.reason", "final_type", "final_title")


@query(
    """WITH a AS (SELECT c_custkey AS doc_id, c_custkey % 6 AS k, unnest([1, 2, 3, 4]) AS attempt FROM customer)
 SELECT doc_id, attempt, CASE WHEN attempt > k THEN NULL ELSE ['no_json', 'validation_error', 'not_json', 'incomplete'][attempt] END AS failure_kind, CASE WHEN attempt > k THEN 'T' WHEN attempt = 2 THEN 'T' END AS title FROM a WHERE attempt <= k + 1"""
)
def completion_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of attempts against a client that answers by a rule."""
    prompts = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 6).cast("string").alias("user_message"))
    return completion.extract(prompts, _replay).select("doc_id", "attempt", "failure_kind", "title")
