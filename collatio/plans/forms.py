"""Views derived from the test tables: pairs of transcriptions, filled forms, runs. The SQL is read by Spark and by DuckDB."""

from __future__ import annotations

from ..operators.parse import Field

#: A dictionary of invented crafts; two of them are words of a third.
CRAFTS = ("alkimador", "brindolar", "castipel", "dromiven", "fulgisto", "garnivek", "hostimar", "jurniq o temblasi", "klimbsor", "lavrinthe", "mospiglen", "mospiglen e nerdivo", "nerdivo", "zunibeka")
NESTED = ("mospiglen e nerdivo",)
#: A form of six fields.
FORM = [
    Field(1, "k1", "Name of owner", "global", "fuzzy", "name", "string"),
    Field(2, "k2", "Made on", "global", "fuzzy", "made", "numeric", format_hint="day month year"),
    Field(3, "k3", "in", "local", "exact", "place", "string"),
    Field(4, "k4", "Kind of craft", "global", "fuzzy", "craft", "dictionary", "crafts"),
    Field(5, "k5", "Sealed by", "local", "fuzzy", "seal", "string"),
    Field(6, "k6", "Entry number", "global", "fuzzy", "number", "numeric"),
]


def as_yaml(name: str, documents: list[str], fields: list[Field]) -> str:
    """A template as its file has it."""
    lines = ["template:", f"  id: {name}", f"  documents: [{', '.join(documents)}]", "  fields:"]
    for f in fields[::-1]:
        lines += [f"    - order: {f.order}", f"      key: {{id: {f.key_id}, text: '{f.key_text}', detection: {{scope: {f.scope}, match: {f.match}}}}}"]
        lines += [f"      value: {{id: {f.field_id}, category: {f.category}" + (f", dictionary: {f.dictionary}" if f.dictionary else "") + "}"]
    return "\n".join(lines) + "\n"


TERM = "CASE c_custkey % 14 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(CRAFTS)) + " END"

#: Reference (normalised: letters, digits and single spaces) and four models' texts for each document's first characters. Spark has no flags in regexp_replace: view() takes ", 'g'" out.
PAIRS = """
SELECT m.model, concat('d', CAST(doc_id AS STRING)) AS file, r AS ref,
  CASE WHEN doc_id % 7 = 3 THEN NULL WHEN doc_id % 11 = 5 THEN ''
    WHEN m.model = 'm_exact' THEN r
    WHEN m.model = 'm_ocr' THEN translate(r, 'lo', '10')
    WHEN m.model = 'm_drop' THEN concat(split_part(r, ' ', 1), substr(r, length(split_part(r, ' ', 1)) + length(split_part(r, ' ', 2)) + 2))
    ELSE concat('new ', r, ' e') END AS hyp
FROM (SELECT doc_id, trim(regexp_replace(lower(regexp_replace(substr(coalesce(text, ''), 1, 240), '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')) AS r FROM documents) p
CROSS JOIN (SELECT 'm_exact' AS model UNION ALL SELECT 'm_ocr' UNION ALL SELECT 'm_drop' UNION ALL SELECT 'm_more') m
"""

#: Names of parts and what two readers made of them: short texts whose similarity is compared letter by letter.
NAMES = """
SELECT concat('p', CAST(p_partkey AS STRING)) AS name, k AS reading, a, CASE WHEN k = 1 THEN translate(a, 'lo', '10') WHEN p_partkey % 5 = 0 THEN '' ELSE concat(substr(a, 4), ' ', substr(a, 1, 9)) END AS b
FROM (SELECT p_partkey, lower(concat(p_name, ' ', p_type)) AS a FROM part) p CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) m
"""

#: Filled forms: kind 1 misspells a key, 2 lacks one, 3 misspells the term, 4 the number, 5 a local key; others are clean.
FORMS = f"""
SELECT concat('c', CAST(c_custkey AS STRING)) AS document, c_custkey % 10 AS kind, term, name, made, place, seal, number,
  concat('Name of owner: ', c_name, '. Made on ', made, ' in ', place, ', Kind of craft ', term, '; Sealed by ', seal, ' Entry number ', number, '.') AS gt_text,
  concat('Name of owner: ', c_name, CASE WHEN c_custkey % 10 = 1 THEN '. Mafe on ' ELSE '. Made on ' END, made, ' in ', place, CASE WHEN c_custkey % 10 = 2 THEN ' ' ELSE ', Kind of craft ' END,
    CASE WHEN c_custkey % 10 = 3 THEN replace(term, 'i', 'j') ELSE term END, CASE WHEN c_custkey % 10 = 5 THEN '; Sealid by ' ELSE '; Sealed by ' END, seal, ' Entry number ', CASE WHEN c_custkey % 10 = 4 THEN concat('9', number) ELSE number END, '.') AS ocr_text
FROM (SELECT c_custkey, c_name, replace(lower(c_name), '#', ' ') AS name, {TERM} AS term, concat(CAST(10 + c_custkey % 19 AS STRING), ' 0', CAST(1 + c_custkey % 9 AS STRING), ' 19', CAST(10 + c_custkey % 90 AS STRING)) AS made,
  lower(replace(n_name, '_', ' ')) AS place, lower(c_mktsegment) AS seal, CAST(100000 + c_custkey AS STRING) AS number FROM customer JOIN nation ON c_nationkey = n_nationkey) x
"""

RUNS = """
SELECT CAST(user_id % 5 AS INT) AS experiment_id, concat('model:', CAST(user_id % 3 AS STRING)) AS model, concat('img', CAST(event_id AS STRING), '.png') AS image,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'skipped' ELSE 'completed' END AS status, value AS wall_seconds, CAST(user_id AS BIGINT) AS tokens
FROM events
"""
