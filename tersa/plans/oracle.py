"""The same queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from tersa.functions.text import SALIENCE
from tersa.plans.catalog import NOW, QUERY, SMALL

TERM = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9a-fA-F]{12,}|\d+|[A-Za-z][A-Za-z0-9_]*"


def tokens(x: str) -> str:
    pieces = rf"regexp_extract_all({x}, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')"
    parts = f"CAST(coalesce(list_sum(list_transform({pieces}, lambda p: 1 + (length(p) - 1) // 6)), 0) AS BIGINT)"
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE greatest(1, {parts} * 3 // 4, length({x}) // 4) END"


def terms(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{TERM}'), lambda t: lower(t))"


def stem(x: str) -> str:
    return rf"regexp_replace({x}, '^(.{{3,}}?)(?:ingly|edly|ing|ed|ies|es|s|e)$', '\1')"


def stems(x: str) -> str:
    return f"list_transform({terms(x)}, lambda t: {stem('t')})"


def salience(x: str) -> str:
    cases = " ".join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in SALIENCE.items())
    return f"coalesce(list_max(list_transform({terms(x)}, lambda t: CASE t {cases} ELSE 0.0::DOUBLE END)), 0.0::DOUBLE)"


def mask(x: str) -> str:
    for pattern, token in (
        (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}(?::\d+)?\b", "<IP>"),
        (r"\b[0-9a-fA-F]{12,}\b", "<HEX>"),
        (r"\d+(?:\.\d+)?", "<NUM>"),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{token}', 'g')"
    return x


def sentences(x: str) -> str:
    x = rf"""regexp_replace({x}, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(30) || '\2', 'g')"""
    x = rf"regexp_replace({x}, '\n{{2,}}', chr(30), 'g')"
    x = rf"regexp_replace({x}, '\n([-*#>0-9])', chr(30) || '\1', 'g')"
    x = rf"list_transform(string_split({x}, chr(30)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))"
    return f"list_filter({x}, lambda s: s <> '')"


REF = "substr(sha256(text), 1, 24)"
MARK = f"""'[ctx-ref ' || {REF} || ' original~' || {tokens("text")} || 'tok type=text; call retrieve(''' || {REF} || ''') for full content]'"""

CONV = f"""conv AS (
  SELECT conv_id, turn AS idx, role, text AS content, {tokens("text")} AS size FROM conversations
), measured AS (
  SELECT *, CAST(sum(size) OVER w AS BIGINT) AS before,
         role = 'system' OR idx >= max(idx) OVER w + 1 - {SMALL.live_messages} AS protected,
         coalesce(arg_max(CASE WHEN role = 'user' THEN content END, CASE WHEN role = 'user' THEN idx END) OVER w, '') AS query
  FROM conv WINDOW w AS (PARTITION BY conv_id)
), flagged AS (
  SELECT *, NOT protected AND content IS NOT NULL AND size >= {SMALL.min_compress_tokens} AND before > {SMALL.target_tokens} AS candidate FROM measured
)"""


def ranked(source: str, query: str, ratio: float) -> str:
    """CTEs from ``source`` (id, text, query) to ``sents``, ``rel``, ``picked`` (id, i, sentence, n, keep)."""
    q = "query" if query == "" else f"'{query}'"
    return f"""split AS (
  SELECT id, text, {q} AS query, {sentences("text")} AS s FROM {source}
), sents AS (
  SELECT id, query, len(s) AS n, unnest(s) AS sentence, unnest(range(len(s))) AS i FROM split
), lens AS (
  SELECT id, i, n, sentence, {stems("sentence")} AS t FROM sents
), per AS (
  SELECT id, coalesce(nullif(avg(len(t)), 0), 1.0::DOUBLE) AS avg_len FROM lens GROUP BY id
), asked AS (
  SELECT DISTINCT id, unnest({stems("query")}) AS term FROM split
), tf AS (
  SELECT l.id, l.i, l.term, count(*) AS tf FROM (SELECT id, i, unnest(t) AS term FROM lens) l JOIN asked USING (id, term) GROUP BY ALL
), df AS (
  SELECT id, term, count(*) AS df FROM tf GROUP BY ALL
), raw AS (
  SELECT tf.id, tf.i, sum(ln(1 + (l.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE
           / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(l.t) / avg_len))) AS raw,
         bool_or(length(term) >= 12 OR contains(term, '-')) AS long_id
  FROM tf JOIN df USING (id, term) JOIN per USING (id) JOIN lens l ON l.id = tf.id AND l.i = tf.i GROUP BY ALL
), rel AS (
  SELECT l.id, l.i, l.n, l.sentence, round(CASE WHEN raw IS NULL THEN 0.0::DOUBLE
           WHEN long_id THEN least(1.0::DOUBLE, 1 - exp(-raw / 3.0::DOUBLE) + 0.35::DOUBLE) ELSE 1 - exp(-raw / 3.0::DOUBLE) END, 12) AS rel
  FROM lens l LEFT JOIN raw USING (id, i)
), scored AS (
  SELECT *, 0.6::DOUBLE * rel + 0.35::DOUBLE * {salience("sentence")} + greatest(0.0::DOUBLE, 1.0::DOUBLE - i / 3.0::DOUBLE) * 0.2::DOUBLE
            + greatest(0.0::DOUBLE, 1.0::DOUBLE - (n - 1 - i) / 3.0::DOUBLE) * 0.2::DOUBLE AS score FROM rel
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, i DESC) AS place FROM scored
), picked AS (
  SELECT *, n <= 3 OR place <= greatest(3, CAST(floor(n * {ratio}::DOUBLE) AS BIGINT)) AS keep FROM placed
), spaced AS (
  SELECT *, i - coalesce(lag(i) OVER (PARTITION BY id ORDER BY i), -1) - 1 AS gap, lead(i) OVER (PARTITION BY id ORDER BY i) IS NULL AS last
  FROM picked WHERE keep
), parts AS (
  SELECT id, i, CASE WHEN gap > 0 THEN '[…' || gap || ' sentence' || CASE WHEN gap > 1 THEN 's' ELSE '' END || ' omitted…]' || chr(10) ELSE '' END
         || sentence || CASE WHEN last AND n - 1 - i > 0 THEN chr(10) || '[…' || (n - 1 - i) || ' sentence' || CASE WHEN n - 1 - i > 1 THEN 's' ELSE '' END || ' omitted…]' ELSE '' END AS part
  FROM spaced
), made AS (
  SELECT id, string_agg(part, chr(10) ORDER BY i) AS body FROM parts GROUP BY id
), brief AS (
  SELECT split.id, split.text, CASE WHEN len(s) <= 3 THEN text ELSE body END AS compressed FROM split LEFT JOIN made USING (id)
)"""


def over_documents(query: str) -> str:
    return "WITH src AS (SELECT doc_id AS id, text FROM documents), " + ranked("src", query, 0.4)


LINE = """strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' user=' || user_id || ' ' ||
  event_type || ' took ' || CAST(round(value) AS BIGINT) || 'ms props=' || props"""
LOGS = f"""numbered AS (
  SELECT user_id % 40 AS blob_id, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) - 1 AS idx, {LINE} AS line FROM events
), marked AS (
  SELECT *, {salience("line")} >= 0.6 AS salient FROM numbered
), grouped AS (
  SELECT blob_id, {mask("line")} AS template, count(*) AS n, min(idx) AS first_idx, arg_min(line, idx) AS first_line, arg_max(line, idx) AS last_line
  FROM marked WHERE NOT salient GROUP BY ALL
)"""
LOG_TEXT = LOGS + """, shown AS (
  SELECT blob_id, first_idx AS idx, 0 AS kept, CASE WHEN n = 1 THEN 1 ELSE 2 END AS k,
         CASE WHEN n = 1 THEN first_line WHEN n = 2 THEN first_line || chr(10) || last_line
              ELSE template || '   [x' || n || ']' || chr(10) || '  e.g. ' || first_line END AS part FROM grouped
  UNION ALL SELECT blob_id, idx, 1, 1, line FROM marked WHERE salient
), body AS (
  SELECT blob_id, string_agg(part, chr(10) ORDER BY idx) AS body, sum(k) AS k, sum(kept) AS kept, sum(1 - kept) AS patterns FROM shown GROUP BY blob_id
), total AS (SELECT blob_id, count(*) AS n FROM numbered GROUP BY blob_id)"""

ORDERS = """o AS (
  SELECT o_custkey % 200 AS blob_id, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) - 1 AS row, * FROM orders
), cells AS (
  SELECT blob_id, row, 0 AS pos, 'key' AS col, CAST(o_orderkey AS VARCHAR) AS cell, o_orderkey::DOUBLE AS num FROM o
  UNION ALL SELECT blob_id, row, 1, 'status', o_orderstatus, NULL FROM o
  UNION ALL SELECT blob_id, row, 2, 'price', CAST(o_totalprice AS VARCHAR), o_totalprice FROM o
  UNION ALL SELECT blob_id, row, 3, 'meta.region', 'eu', NULL FROM o
  UNION ALL SELECT blob_id, row, 4, 'meta.priority', o_orderpriority, NULL FROM o
), whole AS (
  SELECT blob_id, count(*) AS n_rows FROM o GROUP BY blob_id HAVING count(*) > 1
), cols AS (
  SELECT blob_id, col, any_value(pos) AS pos, count(*) AS freq, any_value(n_rows) AS n_rows, count(DISTINCT cell) = 1 AS constant, arg_min(cell, row) AS first_cell
  FROM cells JOIN whole USING (blob_id) GROUP BY blob_id, col
), stats AS (
  SELECT blob_id, col, avg(num) AS m, stddev_pop(num) AS s FROM cells JOIN cols USING (blob_id, col) WHERE num IS NOT NULL AND NOT constant GROUP BY ALL HAVING count(*) >= 8 AND stddev_pop(num) > 0
), outlier AS (
  SELECT DISTINCT blob_id, row FROM cells JOIN stats USING (blob_id, col) WHERE abs(num - m) > 2 * s
), texts AS (
  SELECT blob_id, row, n_rows, '{"key": ' || o_orderkey || ', "status": "' || o_orderstatus || '", "price": ' || o_totalprice || ', "meta.region": "eu", "meta.priority": "' || o_orderpriority || '"}' AS text
  FROM o JOIN whole USING (blob_id)
)"""
PINS = ORDERS + f""", hot AS (
  SELECT *, {salience("text")} >= 0.75 AS hot FROM texts
), pins AS (
  SELECT h.blob_id, h.row, n_rows, text, h.row < 3 OR h.row >= n_rows - 2 AS anchor,
         hot AND sum(CASE WHEN hot THEN 1 ELSE 0 END) OVER (PARTITION BY h.blob_id) <= greatest(3, n_rows // 5) AS salient,
         x.row IS NOT NULL AS outlier
  FROM hot h LEFT JOIN outlier x ON x.blob_id = h.blob_id AND x.row = h.row
)"""
JSON_QUERY = "urgent order with status P"
SELECTION = PINS + f""", t AS (
  SELECT blob_id, row, n_rows, {stems("text")} AS t FROM texts
), per AS (SELECT blob_id, avg(len(t)) AS avg_len FROM t GROUP BY blob_id
), asked AS (SELECT DISTINCT unnest({stems(f"'{JSON_QUERY}'")}) AS term
), tf AS (SELECT blob_id, row, term, count(*) AS tf FROM (SELECT blob_id, row, unnest(t) AS term FROM t) JOIN asked USING (term) GROUP BY ALL
), df AS (SELECT blob_id, term, count(*) AS df FROM tf GROUP BY ALL
), raw AS (
  SELECT tf.blob_id, tf.row, sum(ln(1 + (n_rows - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avg_len))) AS raw,
         bool_or(length(term) >= 12 OR contains(term, '-')) AS long_id
  FROM tf JOIN df USING (blob_id, term) JOIN per USING (blob_id) JOIN t ON t.blob_id = tf.blob_id AND t.row = tf.row GROUP BY ALL
), score AS (
  SELECT p.*, anchor OR salient OR outlier AS pin, round(CASE WHEN raw IS NULL THEN 0.0::DOUBLE WHEN long_id THEN least(1.0::DOUBLE, 1 - exp(-raw / 3.0::DOUBLE) + 0.35::DOUBLE)
           ELSE 1 - exp(-raw / 3.0::DOUBLE) END, 12) AS score
  FROM pins p LEFT JOIN raw r ON r.blob_id = p.blob_id AND r.row = p.row
), rk AS (
  SELECT *, sum(CASE WHEN pin THEN 1 ELSE 0 END) OVER (PARTITION BY blob_id) AS k0, row_number() OVER (PARTITION BY blob_id, pin ORDER BY score DESC, row DESC) - 1 AS r FROM score
), picked AS (
  SELECT *, NOT pin AND score > 0.15 AND (score >= 0.5 OR k0 + r < 30) AS ranked FROM rk
), w AS (
  SELECT *, 30 - sum(CASE WHEN pin OR ranked THEN 1 ELSE 0 END) OVER (PARTITION BY blob_id) AS want FROM picked
), rest AS (
  SELECT *, count(*) OVER (PARTITION BY blob_id, pin OR ranked) AS m, row_number() OVER (PARTITION BY blob_id, pin OR ranked ORDER BY row) - 1 AS at0 FROM w
), chosen AS (
  SELECT *, NOT (pin OR ranked) AND want > 0 AND at0 % greatest(1, m // greatest(want, 1)) = 0 AND at0 // greatest(1, m // greatest(want, 1)) < want AS sampled FROM rest
)"""
TABLE = """, plan AS (
  SELECT blob_id, any_value(n_rows) AS n, string_agg(CASE WHEN NOT constant THEN col END, '|' ORDER BY pos) AS cols,
         string_agg(CASE WHEN constant THEN col || '=' || first_cell END, ' | ' ORDER BY pos) AS legend
  FROM cols GROUP BY blob_id
), line AS (
  SELECT blob_id, row, string_agg(cell, '|' ORDER BY pos) AS line FROM cells JOIN (SELECT blob_id, col, constant FROM cols) USING (blob_id, col) WHERE NOT constant GROUP BY ALL
)"""

STORED = f"""stored AS (
  SELECT {REF} AS ref, text, epoch(TIMESTAMP '{NOW}')::BIGINT - doc_id * 60 AS stored_at FROM documents
), latest AS (SELECT ref, max(stored_at) AS stored_at, any_value(text) AS text FROM stored GROUP BY ref)"""

APPLIED = (
    f"WITH {CONV}, src AS (SELECT conv_id * 1000 + idx AS id, content AS text, query FROM flagged WHERE candidate), "
    + ranked("src", "", SMALL.text_ratio)
    + f""", done AS (
  SELECT f.*, CASE WHEN b.compressed <> b.text THEN {MARK.replace("text)", "b.text)").replace("(text", "(b.text").replace("WHEN text", "WHEN b.text").replace("OR text", "OR b.text")} || chr(10) || b.compressed END AS compressed
  FROM flagged f LEFT JOIN brief b ON b.id = f.conv_id * 1000 + f.idx
), sized AS (
  SELECT *, {tokens("compressed")} AS new_size FROM done
), eff AS (
  SELECT *, CASE WHEN candidate AND compressed IS NOT NULL AND size - new_size >= {SMALL.min_saving_tokens} THEN size - new_size ELSE 0 END AS eff FROM sized
), run AS (
  SELECT *, coalesce(sum(eff) OVER (PARTITION BY conv_id ORDER BY candidate DESC, size DESC, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM eff
), applied AS (
  SELECT *, eff > 0 AND before - so_far > {SMALL.target_tokens} AS applied FROM run
), totals AS (
  SELECT conv_id, any_value(before) AS tokens_before, CAST(any_value(before) - sum(CASE WHEN applied THEN eff ELSE 0 END) AS BIGINT) AS tokens_after FROM applied GROUP BY conv_id
)"""
)

_PYTHON = """\"\"\"Module.\"\"\"
import os
from sys import argv

LIMIT = 10

class {name}:
    \"\"\"Rates of a nation.\"\"\"

    def load(self, path):
        \"\"\"Reads a file.\"\"\"
        with open(path) as f:
            data = f.read()
        rows = data.split(',')
        return rows[:LIMIT]

    def cache_get(self, key):
        value = self.cache.get(key)
        if value is None:
            value = self.load(key)
            self.cache[key] = value
        return value

def main():
    for a in argv:
        print(os.path.basename(a))
        print(len(a))
        print(a.upper())
        print('{nation}')
"""
_BRACES = """package rates;

import java.util.List;

// rates of {nation}
public class Rates {{
    private int base = 1;

    public int load(int a) {{
        int x = a * 2;
        for (int i = 0; i < a; i++) {{
            x += i;
            x -= base;
        }}
        call(x);
        call(a);
        return x;
    }}
}}
"""


def _filled(template: str) -> str:
    """A template as SQL, its names from the nation's."""
    name = "' || upper(substr(id, 1, 1)) || substr(id, 2) || '"
    return "'" + template.format(name="\0", nation="\1").replace("'", "''").replace("\0", name).replace("\1", "' || n_name || '") + "'"


# The patterns of declarations, Python and logs, as the operators have them.
DECLARED = (
    r"^\s*(?:export\s+)?(?:public|private|protected|static|async|final|abstract)?\s*"
    r"(?:function|class|interface|struct|enum|impl|fn|func|def|type|const|var|let|void|int|string|bool|public|private)\b"
)
STRUCTURED = r"^(?://|/\*|\*|#|import |package |using )"
PYTHON_LIKE = r"(?m)^\s*(def |class |import |from |@|if __name__)"
LOG_LIKE = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}|\b(?:INFO|DEBUG|WARN|WARNING|ERROR|FATAL|TRACE)\b"

CODE = f"""n AS (
  SELECT n_nationkey::BIGINT AS k, n_name, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') AS id FROM nation
), code AS (
  SELECT k AS blob_id, {_filled(_PYTHON)} AS text FROM n UNION ALL SELECT k + 1000, {_filled(_BRACES)} FROM n
)"""
OUTLINE = f"""{CODE}, l AS (
  SELECT blob_id, unnest(s) AS line, unnest(range(len(s))) AS place, len(s) AS n_lines
  FROM (SELECT blob_id, string_split(substr(text, 1, length(text) - 1), chr(10)) AS s FROM code)
), kept AS (
  SELECT *, place - coalesce(lag(place) OVER (PARTITION BY blob_id ORDER BY place), -1) - 1 AS gap, lead(place) OVER (PARTITION BY blob_id ORDER BY place) IS NULL AS last
  FROM (SELECT *, trim(line) AS bare, length(line) - length(ltrim(line)) AS indent FROM l)
  WHERE regexp_matches(line, '{DECLARED}') OR regexp_matches(bare, '{STRUCTURED}') OR (indent = 0 AND bare IN ('}}', '}};')) OR (indent <= 2 AND bare LIKE '%{{')
), marks AS (
  SELECT blob_id, place, 0 AS k, '    ... // ' || gap || ' lines elided' AS line, n_lines FROM kept WHERE gap > 0
  UNION ALL SELECT blob_id, place, 1, line, n_lines FROM kept
  UNION ALL SELECT blob_id, n_lines, 0, '    ... // ' || (n_lines - 1 - place) || ' lines elided', n_lines FROM kept WHERE last AND place < n_lines - 1
)"""
#: The rules restated: JSON by a parser, then logs and code by shares of their lines.
ROUTED = f"""{CODE}, texts AS (
  SELECT 'doc' || doc_id AS blob_id, text FROM documents
  UNION ALL SELECT 'log' || blob_id, string_agg(line, chr(10) ORDER BY event_id) FROM (SELECT user_id % 40 AS blob_id, event_id, {LINE} AS line FROM events) GROUP BY blob_id
  UNION ALL SELECT 'json' || (o_custkey % 200), '[' || string_agg('{{"key":' || o_orderkey || ',"status":"' || o_orderstatus || '","price":' || o_totalprice
    || ',"meta":{{"region":"eu","priority":"' || o_orderpriority || '"}}}}', ',' ORDER BY o_orderkey) || ']' FROM orders GROUP BY o_custkey % 200
  UNION ALL SELECT 'code' || blob_id, text FROM code
), split AS (
  SELECT blob_id, text, CASE WHEN text LIKE '%' || chr(10) THEN string_split(substr(text, 1, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS s FROM texts
), probed AS (
  SELECT *, list_filter(s, lambda x: regexp_matches(x, '\\S'))[:50] AS shown, s[:80] AS head, len(list_filter(s, lambda x: regexp_matches(x, '\\S'))) AS n_full FROM split
), shares AS (
  SELECT *, len(list_filter(shown, lambda x: regexp_matches(x, '{LOG_LIKE}'))) AS stamped,
         len(list_filter(head, lambda x: regexp_matches(x, '{DECLARED}'))) + len(list_filter(head, lambda x: regexp_matches(x, '(?:\\{{|\\}}|\\);)\\s*$'))) AS shaped,
         len(regexp_extract_all(text, '{PYTHON_LIKE}')) AS hints
  FROM probed
)"""

SQL: dict[str, str] = {
    "token_estimate": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
    "conv_tokens": f"SELECT conv_id, CAST(sum({tokens('text')}) AS BIGINT) AS tokens, count(*) AS turns FROM conversations GROUP BY conv_id",
    "budget_gate": f"WITH {CONV} SELECT conv_id, any_value(before) AS before, any_value(before) > {SMALL.target_tokens} AS over FROM flagged GROUP BY conv_id",
    "protected_messages": f"WITH {CONV} SELECT conv_id, idx, protected FROM flagged",
    "candidates_ordered": f"WITH {CONV} SELECT conv_id, idx, size, row_number() OVER (PARTITION BY conv_id ORDER BY size DESC, idx) AS place FROM flagged WHERE candidate",
    "last_user_query": f"WITH {CONV} SELECT conv_id, any_value(query) AS query FROM flagged GROUP BY conv_id",
    "content_ref": f"SELECT doc_id, {REF} AS ref FROM documents",
    "content_ref_salted": "SELECT doc_id, substr(sha256('tenant-7' || chr(0) || text), 1, 24) AS ref FROM documents",
    "valid_ref": f"""SELECT doc_id, shape, regexp_full_match(ref, '[0-9a-f]{{24}}') AS valid FROM (
        SELECT doc_id, unnest([{REF}, upper({REF}), substr({REF}, 1, 23), {REF} || chr(10), '']) AS ref, unnest(range(5)) AS shape FROM documents)""",
    "marker": f"SELECT doc_id, {MARK} AS marker FROM documents",
    "terms": f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('text')}) AS term FROM documents) GROUP BY term",
    "stems": f"SELECT DISTINCT term, {stem('term')} AS stem FROM (SELECT unnest({terms('text')}) AS term FROM documents)",
    "term_freq": f"SELECT doc_id, stem, count(*) AS tf FROM (SELECT doc_id, unnest({stems('text')}) AS stem FROM documents) GROUP BY ALL",
    "doc_freq": f"SELECT stem, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({stems('text')}) AS stem FROM documents) GROUP BY stem",
    "idf": f"""WITH d AS (SELECT stem, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({stems("text")}) AS stem FROM documents) GROUP BY stem)
        SELECT stem, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 9) AS idf FROM d""",
    "salience": f"SELECT event_id, {salience('line')} AS salience FROM (SELECT event_id, {LINE} AS line FROM events)",
    "sentences": f"SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS sentence FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)",
    "bm25_sentences": over_documents(QUERY) + " SELECT id AS doc_id, i, round(rel, 9) AS relevance FROM rel",
    "bm25_long_id_boost": over_documents("of oftenthstthoring ciónciónarmente enauxvitionellement the") + " SELECT id AS doc_id, i, round(rel, 9) AS relevance FROM rel",
    "text_select": over_documents(QUERY) + " SELECT id AS doc_id, i FROM picked WHERE keep",
    "text_gaps": over_documents(QUERY)
    + """, g AS (SELECT id, gap FROM spaced UNION ALL SELECT id, n - 1 - i FROM spaced WHERE last)
        SELECT id AS doc_id, count(*) AS gaps, CAST(sum(gap) AS BIGINT) AS omitted FROM g WHERE gap > 0 GROUP BY id""",
    "text_compress": over_documents(QUERY) + " SELECT id AS doc_id, compressed FROM brief",
    "log_mask": f"SELECT event_id, {mask('line')} AS template FROM (SELECT event_id, {LINE} AS line FROM events)",
    "log_groups": f"WITH {LOGS} SELECT blob_id, template, n, first_idx, first_line, last_line FROM grouped",
    "log_salient": f"WITH {LOGS} SELECT blob_id, idx, line FROM marked WHERE salient",
    "log_compress": f"""WITH {LOG_TEXT} SELECT blob_id, '[log summary: ' || n || ' lines -> ' || CAST(k AS BIGINT) || ' shown; ' || CAST(patterns AS BIGINT) || ' unique patterns; '
        || CAST(kept AS BIGINT) || ' error/warn lines kept verbatim]' || chr(10) || body AS compressed FROM total JOIN body USING (blob_id)""",
    "json_cells": f"WITH {ORDERS} SELECT blob_id, row, col, cell FROM cells JOIN whole USING (blob_id)",
    "json_columns": f"WITH {ORDERS} SELECT blob_id, col, freq, n_rows, constant FROM cols",
    "json_outliers": f"WITH {ORDERS} SELECT blob_id, row FROM outlier",
    "json_pins": f"WITH {PINS} SELECT blob_id, row, anchor, salient, outlier FROM pins",
    "json_selection": f"WITH {SELECTION} SELECT blob_id, row, ranked, sampled, n_rows <= 30 OR pin OR ranked OR sampled AS keep FROM chosen",
    "json_table": f"""WITH {ORDERS}{TABLE}, body AS (SELECT blob_id, string_agg(line, chr(10) ORDER BY row) AS body FROM line GROUP BY blob_id)
        SELECT blob_id, '#table cols=' || cols || ' rows=' || n || CASE WHEN legend IS NULL THEN '' ELSE chr(10) || '#every-row: ' || legend END || chr(10) || body AS compressed, false AS lossy
        FROM plan JOIN body USING (blob_id)""",
    "json_table_lossy": f"""WITH {SELECTION}{TABLE}, kept AS (
          SELECT blob_id, row, row - lag(row) OVER (PARTITION BY blob_id ORDER BY row) - 1 AS gap FROM chosen WHERE n_rows <= 30 OR pin OR ranked OR sampled
        ), body AS (
          SELECT blob_id, count(*) AS shown, string_agg(CASE WHEN n > 30 AND gap > 0 THEN '…(' || gap || ' rows omitted)…' || chr(10) ELSE '' END || line, chr(10) ORDER BY row) AS body
          FROM kept JOIN line USING (blob_id, row) JOIN plan USING (blob_id) GROUP BY blob_id
        ) SELECT blob_id, '#table cols=' || cols || ' rows=' || CASE WHEN n > 30 THEN shown || 'of' || n ELSE '' || n END
          || CASE WHEN legend IS NULL THEN '' ELSE chr(10) || '#every-row: ' || legend END || chr(10) || body AS compressed, n > 30 AS lossy FROM plan JOIN body USING (blob_id)""",
    "json_minify": """SELECT o_custkey % 200 AS blob_id, '{"first":' || min(o_orderkey) || ',"last":' || max(o_orderkey) || ',"n":[' || count(*) || ',null,true]}' AS compressed
        FROM orders GROUP BY ALL""",
    "line_jaccard": f"""WITH s AS (SELECT doc_id, list_distinct({stems("text")}) AS s FROM documents), p AS (
          SELECT x.doc_id, x.s AS a, y.s AS b FROM s x JOIN s y ON y.doc_id = x.doc_id + 1)
        SELECT doc_id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 12) AS jaccard FROM p""",
    "compress_blob": over_documents(QUERY)
    + f" SELECT id AS doc_id, 'text' AS content_type, {REF} AS ref, true AS lossy, {MARK} || chr(10) || compressed AS compressed FROM brief WHERE compressed <> text",
    "budget_apply": APPLIED
    + " SELECT conv_id, idx, applied, CASE WHEN applied THEN substr(sha256(content), 1, 24) END AS ref, CAST(CASE WHEN applied THEN eff ELSE 0 END AS BIGINT) AS saved, CASE WHEN applied THEN compressed ELSE content END AS content FROM applied",
    "savings": APPLIED
    + " SELECT conv_id, tokens_before, tokens_after, round(CASE WHEN tokens_before = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - tokens_after::DOUBLE / tokens_before END, 9) AS ratio FROM totals",
    "session_stats": APPLIED
    + """, s AS (SELECT CAST(sum(tokens_before) AS BIGINT) AS b, CAST(sum(tokens_after) AS BIGINT) AS a FROM totals)
        SELECT b AS tokens_in, a AS tokens_out, 'tokens in: ' || format('{:,}', b) || ' | out: ' || format('{:,}', a) || ' | saved: ' || format('{:,}', b - a)
          || ' (' || CAST(round_even(CASE WHEN b = 0 THEN 0 ELSE (b - a)::DOUBLE / b * 100 END, 0) AS INTEGER) || '%)' AS line FROM s""",
    "store_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "ttl_purge": f"WITH {STORED} SELECT ref, stored_at FROM latest WHERE epoch(TIMESTAMP '{NOW}')::BIGINT - stored_at <= 21600",
    "lru_bound": f"WITH {STORED} SELECT ref, stored_at FROM latest ORDER BY stored_at DESC, ref LIMIT 100",
    "memo_dedupe": f"SELECT substr(sha256(text || chr(0) || '{QUERY}'), 1, 24) AS memo, min(doc_id) AS doc_id, count(*) AS uses FROM documents GROUP BY memo",
    "template_counts": f"""SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour,
        {mask("(CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END || ' user=' || user_id || ' ' || event_type || ' ' || props)")} AS template, count(*) AS n FROM events GROUP BY ALL""",
    "route": f"""WITH {ROUTED} SELECT blob_id, CASE
        WHEN regexp_matches(text, '^\\s*[\\[{{]') AND json_valid(text) THEN 'json'
        WHEN n_full >= 10 AND stamped >= len(shown) * 0.4 THEN 'log'
        WHEN len(s) >= 8 AND (hints >= 3 OR shaped >= len(head) * 0.25) THEN 'code' ELSE 'text' END AS content_type FROM shares""",
    "mixed_roundtrip": f"WITH {ROUTED} SELECT blob_id, md5(text) AS md5 FROM texts",
    "code_outline_lines": f"""WITH {OUTLINE} SELECT blob_id, row_number() OVER (PARTITION BY blob_id ORDER BY place, k) - 1 AS "at", line FROM marks""",
    "code_generic": f"""WITH {OUTLINE}, body AS (SELECT blob_id, any_value(n_lines) AS n_lines, string_agg(line, chr(10) ORDER BY place, k) AS body FROM marks GROUP BY blob_id)
        SELECT blob_id, CASE WHEN length(body) < length(text) * 0.85 THEN '// skeleton of ' || n_lines || '-line file (bodies elided)' || chr(10) || body END AS compressed
        FROM code LEFT JOIN body USING (blob_id)""",
}
