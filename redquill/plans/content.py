"""Queries over structured content: Markdown blocks, tables, lists, routing and text rules.

The driver's documents hold next to no Markdown, so most queries run over their
lines marked up by a fixed rule (``MD``): headings, tables with and without a
separator, bullets, numbered items and blank lines, over the whole table.
"""

from __future__ import annotations

from ..functions.dialect import MARKER
from .catalogue import paras, query

SPACE = r"[ \t\n\x0B\f\r]"
# Separator rows of tables, in their strict and their short form.
SEPARATOR = r"^\|?( *:?-{3,}:? *\|)+( *:?-{3,}:? *)?$"
BULLET = r"[-*+\x{2022}]"


def md(d) -> str:
    """CTEs lines (doc_id, idx, line) and classed (with kind)."""
    n = "CAST(idx AS VARCHAR(12))"
    line = f"""CASE idx % 11 WHEN 3 THEN concat('## ', norm) WHEN 5 THEN concat('| ', replace(norm, '|', ''), ' | x |') WHEN 6 THEN CASE WHEN idx % 2 = 0 THEN '|---|---|' ELSE concat('| y', {n}, ' |') END
    WHEN 7 THEN CASE WHEN idx % 3 = 0 THEN '' ELSE concat('| ', {n}, ' | z |') END WHEN 8 THEN concat('- ', norm) WHEN 9 THEN concat({n}, '. ', norm) WHEN 10 THEN '' ELSE norm END"""
    kind = f"""CASE WHEN trim(line) = '' THEN 'blank' WHEN {d.matches('line', '^ *#{1,9} +[^ ]')} THEN 'heading' WHEN trim(line) LIKE '|%' AND trim(line) LIKE '%|' THEN 'table'
    WHEN {d.matches('line', '^ *' + MARKER + ' ')} THEN 'list' ELSE 'paragraph' END"""
    return f"{paras(d)}, lines AS (SELECT doc_id, idx, {line} AS line FROM norms), classed AS (SELECT doc_id, idx, line, {kind} AS kind FROM lines)"


def blocks(d) -> str:
    """Adds CTE placed: every line that is not blank with the number of its block."""
    fresh = "CASE WHEN kind <> 'blank' AND (kind = 'heading' OR kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY idx), 'blank')) THEN 1 ELSE 0 END"
    return f"""{md(d)}, begun AS (SELECT *, {fresh} AS fresh FROM classed),
    numbered AS (SELECT doc_id, idx, line, kind, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INT) AS block FROM begun),
    placed AS (SELECT doc_id, idx, line, kind, block FROM numbered WHERE kind <> 'blank')"""


@query
def structured_blocks(d):
    """Blocks of each document: paragraphs' lines joined by a space, others' by a line break."""
    line_break = r"\n" if d.spark else "\n"
    joined = f"CASE WHEN max(kind) = 'paragraph' THEN {d.ordered_join('trim(line)', 'idx', ' ')} ELSE {d.ordered_join('trim(line)', 'idx', line_break)} END"
    return f"{blocks(d)} SELECT doc_id, block, max(kind) AS kind, CAST(min(idx) AS INT) AS first_line, count(*) AS n_lines, {joined} AS markdown FROM placed GROUP BY doc_id, block"


@query
def structured_needed(d):
    """Documents that need structure: several blocks, a heading, a table, or a list of several items."""
    return f"""{blocks(d)}, b AS (SELECT doc_id, block, max(kind) AS kind, count(*) AS n FROM placed GROUP BY doc_id, block)
    SELECT doc_id, count(*) AS n_blocks, (count(*) > 1 OR max(CASE WHEN kind IN ('heading', 'table') OR (kind = 'list' AND n > 1) THEN 1 ELSE 0 END) = 1) AS needed FROM b GROUP BY doc_id"""


@query
def md_table_issues(d):
    """Tables without a separator in their second row, without data rows, or with rows of unequal width."""
    width = "length(trim(line)) - length(replace(trim(line), '|', '')) - 1"
    return f"""{blocks(d)}, r AS (SELECT doc_id, block, idx, {d.matches('trim(line)', SEPARATOR)} AS sep, {width} AS width, row_number() OVER (PARTITION BY doc_id, block ORDER BY idx) AS place FROM placed WHERE kind = 'table'),
    t AS (SELECT doc_id, block, min(idx) AS line, max(CASE WHEN sep AND place = 2 THEN 1 ELSE 0 END) AS has_sep, sum(CASE WHEN sep THEN 0 ELSE 1 END) AS n_rows, min(CASE WHEN NOT sep THEN width END) AS narrow, max(CASE WHEN NOT sep THEN width END) AS wide FROM r GROUP BY doc_id, block)
    SELECT doc_id, block, CAST(line AS INT) AS line, 'TABLE_SEPARATOR_REQUIRED' AS code FROM t WHERE has_sep = 0
    UNION ALL SELECT doc_id, block, CAST(line AS INT), 'TABLE_DATA_ROW_REQUIRED' FROM t WHERE n_rows < 2
    UNION ALL SELECT doc_id, block, CAST(line AS INT), 'TABLE_COLUMN_COUNT_MISMATCH' FROM t WHERE n_rows >= 2 AND narrow <> wide"""


@query
def heading_context(d):
    """Each line's nearest heading above it, and how a person would name the line."""
    head = f"CASE WHEN kind = 'heading' THEN {d.replace('line', '^ *#+ +', '')} END"
    last = f"last_value({head}) IGNORE NULLS" if d.spark else f"last_value({head} IGNORE NULLS)"
    window = "OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{md(d)}, h AS (SELECT doc_id, idx, line, kind, {last} {window} AS heading FROM classed)
    SELECT doc_id, idx, heading, CASE WHEN kind = 'heading' THEN heading WHEN heading IS NULL THEN substring(line, 1, 120) ELSE concat(heading, ' — ', substring(line, 1, 120)) END AS reference FROM h WHERE kind <> 'blank'"""


@query
def content_type(d):
    """A document is a table, a bullet list, a numbered list or a paragraph, by its lines."""
    table = f"max(CASE WHEN trim(line) LIKE '|%' AND NOT {d.matches('trim(line)', SEPARATOR)} THEN 1 ELSE 0 END) = 1"
    loose = d.matches("line", "^ *" + MARKER)
    bullet = d.matches("line", "^ *" + BULLET)
    return f"""{md(d)} SELECT doc_id, CASE WHEN {table} THEN 'table' WHEN max(CASE WHEN {bullet} THEN 1 ELSE 0 END) = 1 THEN 'bullet_list' WHEN max(CASE WHEN {loose} THEN 1 ELSE 0 END) = 1 THEN 'numbered_list' ELSE 'paragraph' END AS content_type
    FROM lines GROUP BY doc_id"""


@query
def route_plan(d):
    """How new content for a paragraph is applied; every fifth document's old text counts as empty."""
    trimmed = d.replace("text", f"^{SPACE}+|{SPACE}+$", "")
    listed = f"(contains(text, chr(10)) AND {d.matches(trimmed, '(?m)^[ \\t]*' + MARKER + '[ \\t]+')})"
    inline = d.matches("text", r"\*\*.+?\*\*|\*.+?\*|__.+?__|_.+?_|`.+?`|~~.+?~~|\+\+.+?\+\+")
    block = f"({d.matches('text', '(?m)^[ \\t]*([-*+]|[0-9]+\\.|[0-9]+\\.[0-9]+(\\.[0-9]+)*\\.?|[A-Za-z]\\.|[ivxlcIVXLC]+\\.|\\([a-z]\\))[ \\t]+|^#{1,9}[ \\t]')} OR {d.matches('text', '\\|.*\\|.*\\n')} OR contains(text, concat(chr(10), chr(10))))"
    return f"""SELECT doc_id, CASE WHEN {listed} THEN 'structured_list_direct' WHEN doc_id % 5 = 0 AND {inline} THEN 'empty_formatted_text' WHEN doc_id % 5 = 0 THEN 'empty_html' WHEN {block} THEN 'block_html' ELSE 'ooxml_engine' END AS route,
    {inline} AS has_inline, {block} AS has_block FROM documents WHERE text IS NOT NULL"""


# --- lists ----------------------------------------------------------------------


def typed(d, line: str) -> str:
    """Family of a typed marker; what the list format refuses has a reason after a colon."""
    gap = r"[ \t\x{00A0}]"
    m = lambda p: d.matches(line, p)
    letters = d.extract(line, f"^{gap}*([A-Za-z]{{1,7}})[.)]{gap}+", 1)
    roman = d.matches(f"upper({letters})", r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$")
    case = f"CASE WHEN {letters} = upper({letters}) THEN 'upper' ELSE 'lower' END"
    return f"""CASE WHEN {m(f'^{gap}*[0-9]+([.][0-9]+)+[.]?{gap}+[^ ]')} THEN 'unsupported:multilevel' WHEN {m(f'^{gap}*[(]([0-9]{{1,3}}|[A-Za-z]{{1,7}})[)]{gap}+[^ ]')} THEN 'unsupported:parenthesized'
    WHEN {m(f'^{gap}*[-*\\x{{2022}}\\x{{2013}}\\x{{00B7}}\\x{{25AA}}\\x{{25E6}}]{gap}+[^ ]')} THEN 'bullet' WHEN {m(f'^{gap}*0{{1,3}}[.)]{gap}+[^ ]')} THEN 'unsupported:zero' WHEN {m(f'^{gap}*[0-9]{{1,3}}[.)]{gap}+[^ ]')} THEN 'decimal'
    WHEN NOT {m(f'^{gap}*([A-Z]{{1,7}}|[a-z]{{1,7}})[.)]{gap}+[^ ]')} THEN 'none' WHEN length({letters}) = 1 AND {roman} THEN concat({case}, 'Letter|', {case}, 'Roman') WHEN length({letters}) = 1 THEN concat({case}, 'Letter') WHEN {roman} THEN concat({case}, 'Roman') ELSE 'none' END"""


@query
def typed_marker_family(d):
    """Candidates of typed list markers; a letter that is also a roman numeral has two."""
    rows = "(VALUES (-1, '1. a'), (-2, '2.1 b'), (-3, '(a) c'), (-4, 'iv) d'), (-5, 'C. e'), (-6, '- f'), (-7, '12) g'), (-8, 'b. h'), (-9, '0. i'), (-10, 'Iv. j'), (-11, 'iiii. k'), (-12, 'XIV) l'), (-13, 'plain')) AS t(idx, line)"
    return f"""{md(d)}, u AS (SELECT doc_id, idx, line FROM lines UNION ALL SELECT CAST(0 AS BIGINT), idx, line FROM {rows}), f AS (SELECT doc_id, idx, {typed(d, 'line')} AS family FROM u)
    SELECT doc_id, idx, family FROM f WHERE family <> 'none' OR doc_id = 0"""


@query
def list_markers_stripped(d):
    """List items without their markers, up to four of them in a row."""
    text = "trim(line)"
    for _ in range(4):
        text = f"trim({d.replace(text, '^ *' + MARKER + ' +', '')})"
    return f"{md(d)} SELECT doc_id, idx, {text} AS item FROM classed WHERE kind = 'list'"


@query
def roman_value(d):
    """Values of roman numerals: the letters' sum, less twice what stands before a greater letter."""
    count = lambda s: f"CAST((length(label) - length(replace(label, '{s}', ''))) / {len(s)} AS INT)"
    whole = " + ".join(f"{v} * {count(s)}" for s, v in (("M", 1000), ("D", 500), ("C", 100), ("L", 50), ("X", 10), ("V", 5), ("I", 1)))
    less = " + ".join(f"{v} * {count(s)}" for s, v in (("CM", 200), ("CD", 200), ("XC", 20), ("XL", 20), ("IX", 2), ("IV", 2)))
    from .catalogue import roman

    return f"WITH t AS ({d.number_rows(3000)}), l AS (SELECT n, {roman(d, 'n')} AS label FROM t) SELECT n, label, {whole} - ({less}) AS value FROM l"


@query
def markdown_export(d):
    """Lines as Markdown again: headings with one sign a level, items below their list's indent."""
    return f"""{md(d)} SELECT doc_id, idx, CASE kind WHEN 'heading' THEN concat('# ', {d.replace('line', '^ *#+ +', '')}) WHEN 'list' THEN concat(CASE WHEN {d.matches('line', '^ *' + BULLET + ' ')} THEN '- ' ELSE '1. ' END, trim({d.replace('line', '^ *' + MARKER + ' +', '')})) ELSE trim(line) END AS markdown
    FROM classed WHERE kind <> 'blank'"""


# --- text rules --------------------------------------------------------------------


@query
def plain_text_intent(d):
    """Lines whose accepted result is what they say: no Markdown, list or table syntax."""
    signs = d.matches("line", r"\+\+|==|[*_#>`|~\[\]\\]")
    marker = d.matches("line", r"^[ \t]*([-+\x{2022}\x{25CF}]|[A-Za-z0-9]{1,5}[.)]|[0-9][0-9.]*[.)]?|\([0-9A-Za-z_]{1,4}\))[ \t]")
    return f"{md(d)} SELECT doc_id, idx, (line <> '' AND NOT {signs} AND NOT {marker}) AS plain FROM lines"


@query
def table_source_lines(d):
    """Lines that look like the source of a table: alone in brackets, ending with a colon, or short with such signs."""
    t = "norm"
    return f"""{paras(d)} SELECT doc_id, idx FROM norms WHERE norm <> '' AND (lower(norm) = 'and' OR {d.matches(t, ':$')} OR (length(norm) <= 90 AND NOT {d.matches(t, '[.!?]$')} AND {d.matches(t, r'[:()\[\]]')}) OR {d.matches(t, r'^[\[(]')})"""


@query
def formatting_removal_intent(d):
    """Turns that ask for formatting to go."""
    words = d.matches("lower(text)", "unbold|unitalic|ununderline|clear formatting|remove formatting|remove .*format|remove .*style|plain text|de-?bold|strip formatting")
    return f"SELECT conv_id, turn, ({words} OR ({d.matches('lower(text)', r'\bremove\b')} AND {d.matches('lower(text)', r'\b(bold|italic|underline|highlight|format|formatting|style)\b')})) AS asks FROM conversations"


@query
def response_prefix(d):
    """Replies without the fixed words that models put before a text; every third turn has such words put before it."""
    said = "concat(CASE turn % 3 WHEN 0 THEN concat('Here is the text:', chr(10)) WHEN 1 THEN concat('SURE, I can help: ', chr(13), chr(10)) ELSE '' END, text)"
    prefix = r"(?i)^(?:Here is the redline:|Here is the text:|Sure, I can help:|Here\x27s the updated text:)[ \t]*\r?\n"
    return f"SELECT conv_id, turn, {d.replace(said, prefix, '')} AS reply FROM conversations"


@query
def xml_escaped(d):
    """Texts with the five entities."""
    text = "text"
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = f"replace({text}, '{sign}', '{entity}')"
    return f"SELECT doc_id, replace({text}, chr(39), '&apos;') AS escaped FROM documents"


@query
def entry_names(d):
    """Names of package entries, normalised: urls' slashes turned, doubled and led by ./"""
    back = "chr(92)"
    raw = f"concat(CASE page_id % 3 WHEN 0 THEN './' WHEN 1 THEN '//' ELSE '' END, replace(url, '/', CASE WHEN page_id % 2 = 0 THEN {back} ELSE '/' END))"
    name = d.replace(d.replace(d.replace(f"replace({raw}, {back}, '/')", "^/+", ""), r"^(\./)+", ""), "/+", "/")
    return f"SELECT page_id, {name} AS entry FROM pages"


@query
def diff_token_counts(d):
    """Tokens of each turn by the difference kernel's split into words and white space, and how many differ."""
    parts = d.extract_all("text", r"[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+")
    distinct = f"size(array_distinct({parts}))" if d.spark else f"len(list_distinct({parts}))"
    return f"SELECT conv_id, turn, CAST({'size' if d.spark else 'len'}({parts}) AS INT) AS tokens, CAST({distinct} AS INT) AS vocabulary, {distinct} > 262144 AS over_limit FROM conversations"


@query
def localized_matches(d):
    """What a replacement finds in each document: its place, or the code of the refusal."""
    each = "explode(sequence(1, 4))" if d.spark else "unnest(range(1, 5))"
    find, occurrence = "CASE request WHEN 1 THEN 'the' WHEN 2 THEN 'an' WHEN 3 THEN 'ing ' ELSE 'zzqx' END", "CASE request WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END"
    found = "CAST((length(text) - length(replace(text, find, ''))) / length(find) AS INT)"
    return f"""WITH e AS (SELECT doc_id, text, {each} AS request FROM documents WHERE text IS NOT NULL), q AS (SELECT doc_id, text, CAST(request AS INT) AS request, {find} AS find, {occurrence} AS occurrence FROM e),
    m AS (SELECT doc_id, request, occurrence, {found} AS n FROM q)
    SELECT doc_id, request, n, CASE WHEN n = 0 OR occurrence > n THEN 'PATCH_SOURCE_NOT_FOUND' WHEN occurrence = 0 AND n > 1 THEN 'AMBIGUOUS_PATCH_SOURCE' END AS code FROM m"""


# --- parts of packages: orders stand for parts, lines for their entries ---------------


@query
def comment_parts_merge(d):
    """Comments of two parts in one: the id of one that both hold is an error, all others go in."""
    return """WITH own AS (SELECT l_orderkey AS part, l_linenumber AS id, 1 AS side FROM lineitem WHERE l_returnflag <> 'R'), other AS (SELECT l_orderkey AS part, l_linenumber AS id, 2 AS side FROM lineitem WHERE l_linestatus = 'F'),
    u AS (SELECT * FROM own UNION ALL SELECT * FROM other) SELECT part, id, count(*) AS copies, CASE WHEN count(*) > 1 THEN 'DUPLICATE_COMMENT_ID' ELSE 'merged' END AS outcome FROM u GROUP BY part, id"""


@query
def sibling_parts_reconcile(d):
    """Entries of a sibling part without their comment go; comments without an entry get one."""
    return """WITH comments AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), entries AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'A')
    SELECT coalesce(c.id, e.id) AS id, CASE WHEN c.id IS NULL THEN 'drop' WHEN e.id IS NULL THEN 'add' ELSE 'keep' END AS action FROM comments c FULL OUTER JOIN entries e ON c.id = e.id"""


@query
def revision_ids_renumbered(d):
    """Ids of a part that the body holds too get new ones above all that are taken, in order."""
    return """WITH taken AS (SELECT l_orderkey AS doc, l_linenumber AS id FROM lineitem WHERE l_returnflag = 'N'), own AS (SELECT l_orderkey AS doc, l_linenumber AS id, l_suppkey AS at FROM lineitem WHERE l_linestatus = 'O'),
    hits AS (SELECT own.doc, own.id, own.at, CASE WHEN t.id IS NULL THEN 0 ELSE 1 END AS hit FROM own LEFT JOIN (SELECT DISTINCT doc, id FROM taken) t ON t.doc = own.doc AND t.id = own.id),
    most AS (SELECT doc, max(id) AS top FROM (SELECT doc, id FROM taken UNION ALL SELECT doc, id FROM own) x GROUP BY doc)
    SELECT h.doc, h.id, h.at, CASE WHEN hit = 0 THEN h.id ELSE top + sum(hit) OVER (PARTITION BY h.doc ORDER BY h.id, h.at ROWS UNBOUNDED PRECEDING) END AS new_id FROM hits h JOIN most m ON m.doc = h.doc"""


@query
def numbering_merge(d):
    """Numbering definitions of two parts: equal ones are one, unequal ones of one id conflict."""
    return """WITH a AS (SELECT o_custkey AS id, min(o_orderpriority) AS def FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey), b AS (SELECT o_custkey AS id, min(o_orderpriority) AS def FROM orders WHERE o_orderkey % 2 = 1 GROUP BY o_custkey)
    SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'kept' WHEN a.def = b.def THEN 'same' ELSE 'NUMBERING_ID_CONFLICT' END AS outcome FROM a FULL OUTER JOIN b ON a.id = b.id"""


@query
def table_cell_diff(d):
    """Cells of two versions of a table by row and column: rows that only one has, and cells that changed."""
    side = lambda where, flag: f"SELECT l_orderkey AS tbl, l_linenumber AS r, 1 AS c, {flag} AS cell FROM lineitem WHERE {where} UNION ALL SELECT l_orderkey, l_linenumber, 2, l_linestatus FROM lineitem WHERE {where}"
    return f"""WITH old AS ({side('l_linenumber <= 5', 'l_returnflag')}), new AS ({side('l_linenumber >= 2', "CASE WHEN l_partkey % 10 = 0 THEN 'x' ELSE l_returnflag END")}),
    j AS (SELECT coalesce(o.tbl, n.tbl) AS tbl, coalesce(o.r, n.r) AS r, coalesce(o.c, n.c) AS c, o.cell AS old_cell, n.cell AS new_cell FROM old o FULL OUTER JOIN new n ON o.tbl = n.tbl AND o.r = n.r AND o.c = n.c)
    SELECT tbl, r, CASE WHEN new_cell IS NULL OR old_cell IS NULL THEN 0 ELSE c END AS c, CASE WHEN new_cell IS NULL THEN 'row_delete' WHEN old_cell IS NULL THEN 'row_insert' ELSE 'cell_modify' END AS change
    FROM j WHERE (c = 1 AND (new_cell IS NULL OR old_cell IS NULL)) OR old_cell <> new_cell"""


@query
def capture_errors(d):
    """Errors of a batch's captures: keys declared twice, keys that nothing declares, and several consumers that write."""
    return """WITH made AS (SELECT l_orderkey AS doc, l_partkey % 5 AS capture, count(*) AS n FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY l_orderkey, l_partkey % 5),
    used AS (SELECT l_orderkey AS doc, l_suppkey % 5 AS capture, sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END) AS writers FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY l_orderkey, l_suppkey % 5)
    SELECT doc, capture, 'DUPLICATE_CAPTURE_KEY' AS code FROM made WHERE n > 1 UNION ALL SELECT u.doc, u.capture, 'CAPTURE_NOT_FOUND' FROM used u LEFT JOIN made m ON m.doc = u.doc AND m.capture = u.capture WHERE m.doc IS NULL
    UNION ALL SELECT doc, capture, 'CAPTURE_FANOUT_CONFLICT' FROM used WHERE writers > 1"""


@query
def header_part_selected(d):
    """A part selected by kind and section: exactly one must fit."""
    return """SELECT user_id, event_type, min(event_id) AS first_part, CASE WHEN count(*) = 1 THEN 'found' ELSE 'PART_AMBIGUOUS' END AS outcome FROM events GROUP BY user_id, event_type"""


@query
def plain_text_export(d):
    """Documents as text: white space collapsed in each line, empty lines left out."""
    line_break = r"\n" if d.spark else "\n"
    return f"{paras(d)} SELECT doc_id, {d.ordered_join('norm', 'idx', line_break, "norm <> ''")} AS text FROM norms GROUP BY doc_id"


@query
def unattributed_revisions(d):
    """Conversations with revisions of nobody, and how many authors the others have."""
    return "SELECT conv_id, max(CASE WHEN role IS NULL OR trim(role) = '' THEN 1 ELSE 0 END) = 1 AS unattributed, count(DISTINCT lower(trim(role))) AS authors FROM conversations GROUP BY conv_id"
