"""Portable views that stand in for parsed documents, over the supplied star-schema tables.

Each statement runs unchanged in Spark SQL and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.functions import text

PARA = """
SELECT user_id AS doc_id, event_id AS pos,
 CASE WHEN event_id % 31 = 0 THEN 'Heading 1' WHEN event_id % 31 IN (7, 19) THEN 'Heading 2'
      WHEN event_id % 31 = 25 THEN 'Heading 3' WHEN event_id % 31 IN (3, 11) THEN 'Normal' WHEN event_id % 5 = 2 THEN 'List Bullet' ELSE 'List Number' END AS style_name,
 CASE WHEN event_id % 31 IN (0, 7, 19, 25, 3, 11) THEN 0 ELSE 1 + CAST(event_id % 4 AS INT) END AS list_level,
 CASE WHEN event_id % 31 = 0 THEN CASE CAST(floor(event_id / 31) AS BIGINT) % 7 WHEN 0 THEN 'Overview' WHEN 1 THEN 'Materials' WHEN 2 THEN 'Procedure'
        WHEN 3 THEN 'procedure' WHEN 4 THEN 'Notes and Variants' WHEN 5 THEN 'References' ELSE 'Untitled part' END
      WHEN event_id % 31 IN (7, 19) THEN concat('Stage ', event_id % 5)
      WHEN event_id % 31 = 25 THEN 'Reagents'
      ELSE CASE event_id % 13
        WHEN 0 THEN concat('IMPORTANT: keep tube ', event_id % 100, ' cold')
        WHEN 1 THEN 'Crucial - do not vortex the lysate'
        WHEN 2 THEN concat('Samples can be stored at -', event_id % 90, 'o C for months')
        WHEN 3 THEN concat('Spin at ', event_id % 20, ',000 xg for 5 min at 4oC')
        WHEN 4 THEN concat('See sec. ', event_id % 9, '.', event_id % 4, ' for details [', event_id % 6, '] and [2]')
        WHEN 5 THEN 'Note: refer to the buffer table'
        WHEN 6 THEN concat('Add **', event_id % 50, ' uL** buffer _A_ and mix')
        WHEN 7 THEN concat('Last updated: ', event_id % 28 + 1, '-0', event_id % 9 + 1, '-2024')
        WHEN 8 THEN '  double  space   text '
        WHEN 9 THEN 'RNase-free water works well'
        WHEN 10 THEN 'TIP: for best results use fresh stock'
        WHEN 11 THEN concat('Run the python script on the server, step ', event_id % 7)
        ELSE concat('Incubate for ', event_id % 60, ' min at room temperature in the dark') END END AS text
FROM events"""

#: Tables that stand after paragraphs of the same documents: a row a table row.
TABLES_BETWEEN = """
SELECT e.user_id AS doc_id, e.event_id AS pos, r.row_ord,
 CASE r.row_ord WHEN 0 THEN 'Command' WHEN 1 THEN concat('run  bash ', e.event_id % 3) WHEN 2 THEN CASE WHEN e.event_id % 4 = 1 THEN ' ' ELSE 'tube rack' END ELSE 'docker' END AS c1,
 CASE r.row_ord WHEN 0 THEN 'Purpose' WHEN 1 THEN ' first' WHEN 2 THEN '' ELSE CASE WHEN e.event_id % 9 < 4 THEN 'conda install' ELSE 'none' END END AS c2
FROM events e CROSS JOIN (SELECT 0 AS row_ord UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) r
WHERE e.event_id % 6 = 4"""

RUNS = """
SELECT CAST(floor(event_id / 6) AS BIGINT) AS para_id, CAST(event_id % 6 AS INT) AS run_pos,
 CASE event_id % 7 WHEN 0 THEN 'Add ' WHEN 1 THEN concat(event_id % 90, ' uL') WHEN 2 THEN ' buffer ' WHEN 3 THEN '  '
      WHEN 4 THEN '' WHEN 5 THEN ' then mix' ELSE concat('step', event_id % 9, ' ') END AS text,
 (event_id % 5) IN (1, 2) AS bold, (event_id % 4) = 3 AS italic
FROM events"""

TABLES = """
SELECT CAST(floor(p_partkey / 18) AS BIGINT) AS doc_id, CAST(floor(p_partkey / 6) AS BIGINT) % 3 AS table_ord, p_partkey % 6 AS row_ord,
 CASE WHEN CAST(floor(p_partkey / 6) AS BIGINT) % 4 = 0 THEN 2 WHEN CAST(floor(p_partkey / 6) AS BIGINT) % 4 = 3 THEN 1 ELSE 3 END AS n_cols,
 CASE WHEN p_partkey % 6 = 0 THEN 'Reagent' WHEN p_partkey % 6 = 5 THEN 'Total' WHEN p_partkey % 11 = 4 THEN 'incubate 5 min' ELSE p_name END AS c1,
 CASE WHEN p_partkey % 6 = 0 THEN 'Supplier' WHEN p_partkey % 7 = 2 THEN ' ' ELSE p_brand END AS c2,
 CASE WHEN p_partkey % 6 = 0 THEN 'Cat. No. / Notes' WHEN p_partkey % 9 = 5 THEN '' ELSE concat('C', p_partkey) END AS c3
FROM part"""

HEADINGS = """
SELECT d.doc_id, h.ord, concat('Heading ', d.doc_id % 10, '-', h.ord) AS heading
FROM (SELECT DISTINCT CAST(floor(p_partkey / 18) AS BIGINT) AS doc_id FROM part) d
CROSS JOIN (SELECT 0 AS ord UNION ALL SELECT 1) h
WHERE h.ord < d.doc_id % 3"""

FILES = """
SELECT path, min(file_id) AS file_id FROM (
 SELECT concat('/in/', CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'a-b' ELSE 'a/b' END, '/',
  CASE WHEN p_partkey % 4 = 0 THEN upper(replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END, '_', p_size,
  CASE p_partkey % 10 WHEN 7 THEN '.doc' WHEN 8 THEN '.DOCX' WHEN 9 THEN '.pdf' ELSE '.docx' END) AS path, p_partkey AS file_id
 FROM part) f GROUP BY path"""

PAYLOADS = """
SELECT o_orderkey AS payload_id,
 CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('Protocol ', o_orderkey % 500) END AS title,
 CASE o_orderkey % 9 WHEN 0 THEN 'COMPUTATIONAL ' WHEN 1 THEN 'computational' WHEN 2 THEN '' WHEN 3 THEN 'other' ELSE 'wet_lab' END AS section_type,
 CASE o_orderkey % 8 WHEN 0 THEN '2024-03-05' WHEN 1 THEN '5-3-2024' WHEN 2 THEN 'March 2024' WHEN 3 THEN '31/02/2024' WHEN 4 THEN '10/13/2024' WHEN 5 THEN '15 Jan 2023' WHEN 6 THEN NULL ELSE '01/06/2022' END AS date_raw,
 (o_orderkey % 5 = 0) AS has_prereq, CAST(o_orderkey % 3 AS INT) AS n_materials, CAST(o_orderkey % 2 AS INT) AS n_mix,
 CAST(o_orderkey % 7 AS INT) AS n_sections, CAST(1 + o_orderkey % 4 AS INT) AS n_cells, CAST(o_orderkey % 6 AS INT) AS n_steps,
 CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '2' WHEN 2 THEN '' WHEN 3 THEN 'abc' ELSE '-1' END AS after_step_raw,
 CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'user' ELSE concat(' Team  ', o_orderkey % 40) END AS author_raw
FROM orders"""

_PROC = '"procedure": [{"heading": "H", "steps": [], "callouts": []}]'
RESPONSES = f"""
SELECT s.s_suppkey AS doc_id, a.attempt,
 CASE (s.s_suppkey * 3 + a.attempt * 5) % 7
  WHEN 0 THEN concat('```json', chr(10), '{{"title": "T', s.s_suppkey, '", {_PROC}}}', chr(10), '```')
  WHEN 1 THEN concat('Here: {{"title": "A {{b}} ', s.s_suppkey, '", "d": {{"e": 1}}, {_PROC}}} done')
  WHEN 2 THEN 'no object here' WHEN 3 THEN '{{"title": "cut' WHEN 4 THEN '{{"title": "", {_PROC}}}' WHEN 5 THEN '{{bad json}}' ELSE '{{"title": "T", "procedure": []}}' END AS content
FROM supplier s CROSS JOIN (SELECT 1 AS attempt UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) a"""


def _one_of(number: str, values: list[str] | tuple[str, ...]) -> str:
    """SQL for the value at a number."""
    return f"CASE {number} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_MONTH = _one_of("CAST(extract(MONTH FROM o_orderdate) AS INT) - 1", [m.capitalize() for m in text.MONTHS])
_DAY, _NUMBER, _YEAR = (f"CAST(extract({x} FROM o_orderdate) AS INT)" for x in ("DAY", "MONTH", "YEAR"))
#: Dates as people write them.
DATES = f"""
SELECT o_orderkey AS doc_id, o_orderdate, CAST(o_orderkey % 7 AS INT) AS form, CASE o_orderkey % 7
  WHEN 0 THEN concat('Revised ', {_DAY}, ' ', {_MONTH}, ' ', {_YEAR}) WHEN 1 THEN concat({_MONTH}, ' ', {_YEAR}) WHEN 2 THEN concat('of ', lower(substr({_MONTH}, 1, 3)), '  ', {_YEAR})
  WHEN 3 THEN concat('updated ', {_DAY}, '/', {_NUMBER}, '/', {_YEAR}, '.') WHEN 4 THEN concat({_DAY}, '-', {_NUMBER}, '-', {_YEAR}, ' rev') WHEN 5 THEN concat({_DAY}, ' ', upper(substr({_MONTH}, 1, 3)), ' ', {_YEAR})
  ELSE concat('no date ', {_YEAR}) END AS text
FROM orders"""

_LINES = "concat(chr(92), 'n', chr(92), 'n')"
#: Records as JSON texts, as a completion service writes them: all valid.
RECORDS = f"""
SELECT o_orderkey AS doc_id, concat('{{"title": "Protocol ', o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ' with a title that is longer than what a footer holds' ELSE '' END, '", ',
 CASE WHEN o_orderkey % 3 = 0 THEN concat('"subtitle": "Part ', o_orderkey % 5, '", ') ELSE '' END,
 CASE o_orderkey % 4 WHEN 0 THEN '"section_type": "computational", "prerequisites": {{"software": "git", "access": "", "dependencies": "numpy"}}, ' WHEN 1 THEN '"section_type": " WET_LAB", ' ELSE '' END,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat('"author": "Team ', o_custkey, '", ') END, CASE WHEN o_orderkey % 6 = 0 THEN '"version": "2.1", ' ELSE '' END,
 CASE o_orderkey % 3 WHEN 0 THEN concat('"date": "', {_MONTH}, ' ', {_YEAR}, '", ') WHEN 1 THEN '"date": "07/08/2021", ' ELSE '"date": "soon", ' END,
 '"overview": "First ', o_orderkey % 7, CASE WHEN o_orderkey % 2 = 0 THEN concat({_LINES}, ' Second ') ELSE '' END, '", "section_number": "', o_orderkey % 8, '", "section_name": "Name ', o_orderkey % 8, '", ',
 CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 > 0 THEN concat('"materials": [{{"heading": "Salts", "rows": [{{"cells": ["NaCl", "", "x', o_orderkey % 9, '", "more"]}}, {{"cells": ["KCl"], "bold": true}}]}}], ') ELSE '' END,
 CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 5 > 2 THEN '"mix_tables": [{{"heading": "Mix", "rows": [{{"cells": ["Salt", "1 g"]}}, {{"cells": ["Total", "2 g"]}}]}}], ' ELSE '' END,
 '"procedure": [{{"heading": "Prepare", "preamble": ', CASE WHEN o_orderkey % 2 = 0 THEN '"Read all."' ELSE 'null' END,
 ', "steps": [{{"seq": 0, "depth": 0, "step_type": "action", "text": "Run `make`", "code": "make', chr(92), 'n', chr(92), 'nls", "code_language": "bash"}}, {{"seq": 1, "depth": 1, "step_type": "action", "text": "Wait ', o_orderkey % 11,
 '"}}, {{"seq": 2, "depth": 0, "step_type": "stopping_point", "text": "Can be stored"}}, {{"seq": 3, "depth": 1, "step_type": "action", "text": "Hidden"}}], "callouts": [{{"callout_type": "tip", "text": "TIP:  use  ice", "after_step": ',
 CASE o_orderkey % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"0"' ELSE '1' END, '}}]}}], "notes": [', CASE WHEN o_orderkey % 3 = 1 THEN '"one", "two"' ELSE '' END, '], "references": [', CASE WHEN o_orderkey % 4 = 2 THEN '"A book"' ELSE '' END, ']}}') AS json
FROM orders"""

#: Records as JSON texts, most of which break some rule.
BROKEN = """
SELECT o_orderkey AS doc_id, concat('{', CASE o_orderkey % 7 WHEN 0 THEN '"title": " ", ' WHEN 1 THEN '' WHEN 2 THEN '"title": null, ' ELSE concat('"title": "T', o_orderkey, '", ') END,
 CASE o_orderkey % 5 WHEN 0 THEN '"section_type": "computational", ' WHEN 1 THEN '"section_type": "odd", ' ELSE '"section_type": "wet_lab", ' END, CASE WHEN o_orderkey % 6 = 1 THEN '' ELSE '"section_number": "1", ' END,
 '"section_name": "N", ', CASE o_orderkey % 8 WHEN 3 THEN '' WHEN 4 THEN '"overview": ["x"], ' ELSE '"overview": "", ' END,
 CASE o_orderkey % 4 WHEN 0 THEN '"date": "31/12/2024", ' WHEN 1 THEN '"date": "2024-01-01", ' WHEN 2 THEN '"date": "45/01/2024", ' ELSE '' END, CASE WHEN o_orderkey % 3 = 0 THEN '"prerequisites": {"software": "git"}, ' ELSE '' END,
 CASE o_orderkey % 11 WHEN 0 THEN concat('"materials": [{"heading": "h", "rows": [{"cells": ["a", "b"]}]}', CASE WHEN o_orderkey % 2 = 0 THEN ', {"heading": "i", "rows": [{"cells": ["a", "b", "c"]}, {"cells": ["a"]}, {"cells": ["d", "e", "f"]}, {"cells": []}]}, {"heading": "j", "rows": []}' ELSE '' END, '], ') WHEN 1 THEN concat('"materials": [{"heading": "h", "rows": [{"cells": ["a", "b", "c"]}]}', CASE WHEN o_orderkey % 2 = 0 THEN ', {"heading": "i", "rows": [{"cells": ["a", "b", "c"]}, {"cells": ["a"]}, {"cells": ["d", "e", "f"]}, {"cells": []}]}, {"heading": "j", "rows": []}' ELSE '' END, '], "mix_tables": [{"heading": "m", "rows": [{"cells": ["a"]}]}], ') ELSE '' END,
 CASE o_orderkey % 10 WHEN 3 THEN '"notes": "one text", ' WHEN 4 THEN '"notes": ["one", 2, "three"], ' ELSE '' END,
 CASE o_orderkey % 9 WHEN 0 THEN '"procedure": []' WHEN 1 THEN '"section_no": 0' WHEN 2 THEN '"procedure": "x"' ELSE concat('"procedure": [{"heading": "H", "steps": [{"depth": 0, "step_type": "action", "text": "x"}], "callouts": []}, {"heading": "',
   CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE 'H' END, '", "steps": [{"depth": 0, "step_type": "', CASE WHEN o_orderkey % 5 = 3 THEN 'odd' ELSE 'stopping_point' END, '", "text": "', CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'y' END,
   '"}], "callouts": [{"callout_type": "', CASE WHEN o_orderkey % 7 = 5 THEN 'hint' ELSE 'note' END, '", "text": "', CASE WHEN o_orderkey % 7 = 6 THEN '  ' ELSE 'z' END, '", "after_step": ', CASE o_orderkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN '0' WHEN 2 THEN '1' ELSE 'null' END, '}]}]') END, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '}' END) AS json
FROM orders"""


#: Edits of records: a row a line of an order, numbered by their lines.
EDITS = """
SELECT l_orderkey AS doc_id, min(l_linenumber) AS n, CASE l_linenumber WHEN 1 THEN 'section_type' WHEN 2 THEN 'title' WHEN 3 THEN 'procedure[0].steps[3].text' WHEN 4 THEN 'materials' WHEN 5 THEN 'procedure[0].callouts[0].after_step'
  WHEN 6 THEN 'mix_tables' ELSE 'section_type' END AS path,
 CASE l_linenumber WHEN 1 THEN 'computational' WHEN 2 THEN CASE WHEN l_orderkey % 3 = 0 THEN ' ' ELSE concat('"Edited ', l_orderkey, '"') END WHEN 3 THEN CASE WHEN l_orderkey % 5 = 0 THEN '7' ELSE 'said anew' END WHEN 4 THEN '[]'
  WHEN 5 THEN CAST(l_orderkey % 4 AS VARCHAR(9)) WHEN 6 THEN '[]' ELSE 'computational' END AS value
FROM lineitem GROUP BY l_orderkey, l_linenumber"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The view over the tables of a folder. The names are resolved when this returns."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
