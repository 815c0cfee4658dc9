"""Named queries over the driver's tables and the SQL that they must equal.

A query is written once, as a function of the dialect; Catalyst plans one form,
the oracle runs the other. Kernels that SQL cannot express stand below.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import MARKER, ORACLE, SPARK, Dialect
from ..operators import markdown, schedule
from ..operators.textdiff import char_diff, diff_rows, insertion_diff, word_diff as word_changes

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """SQL over the given tables; the session's own views of these names stay as they are."""
    after = r"\b(FROM|JOIN)\s+"  # a name elsewhere is a column or an alias
    made = {name: f"{name}_{uuid.uuid4().hex}" for name in tables if re.search(rf"{after}{name}\b", text)}
    try:
        for name, view in made.items():
            tables[name].createOrReplaceTempView(view)
            text = re.sub(rf"{after}{name}\b", rf"\1 {view}", text)
        return spark.sql(text)
    finally:
        for view in made.values():
            spark.catalog.dropTempView(view)


def query(write: Callable[[Dialect], str]) -> Callable[[Dialect], str]:
    """Registers a query under the function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = write(SPARK)
        return over(spark, text, {name: read(spark, sf_dir, name) for name in TABLES if re.search(rf"\b{name}\b", text)})

    run.__doc__ = write.__doc__
    QUERIES[write.__name__], ORACLES[write.__name__] = run, write(ORACLE)
    return write


def paras(d: Dialect) -> str:
    return f"WITH paras AS ({d.paragraphs()}), norms AS (SELECT doc_id, idx, text, {d.normalised('text')} AS norm FROM paras)"


# --- paragraphs: projection, selection, paging -------------------------------


@query
def para_index(d):
    """Every paragraph with its 1-based index."""
    return f"{paras(d)} SELECT doc_id, idx, text FROM paras"


@query
def para_normalized(d):
    """Texts with white space collapsed and trimmed."""
    return f"{paras(d)} SELECT doc_id, idx, norm FROM norms"


@query
def para_fingerprint(d):
    """FNV-1a fingerprints of id, index, place and text."""
    unit = "chr(31)"
    return f"{paras(d)}, ids AS (SELECT doc_id, idx, concat('', {unit}, CAST(idx AS VARCHAR(12)), {unit}, 'body', {unit}, text) AS identity FROM paras) SELECT doc_id, idx, {d.fnv('identity')} AS fingerprint FROM ids"


@query
def para_search(d):
    """Paragraphs that hold a phrase in any case, with the document's total."""
    return f"{paras(d)} SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS total_matches FROM paras WHERE contains(lower(text), 'the the')"


@query
def para_search_page(d):
    """A page of at most two matches after paragraph 2; the total counts all, next_after is set if more follow."""
    return f"""{paras(d)}, hits AS (SELECT doc_id, idx, count(*) OVER (PARTITION BY doc_id) AS total_matches FROM paras WHERE contains(lower(text), 'an')),
    page AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place, count(*) OVER (PARTITION BY doc_id) AS remaining FROM hits WHERE idx > 2)
    SELECT doc_id, idx, total_matches, CASE WHEN remaining > 2 THEN max(idx) OVER (PARTITION BY doc_id) END AS next_after FROM page WHERE place <= 2"""


@query
def para_context_window(d):
    """Matches and the paragraphs within one of them; which matches a row is context for."""
    return f"""{paras(d)}, hits AS (SELECT doc_id, idx AS hit FROM paras WHERE contains(lower(text), 'the the')),
    near AS (SELECT doc_id, hit, hit + step.s AS idx FROM hits CROSS JOIN (VALUES (-1), (0), (1)) AS step(s))
    SELECT p.doc_id, p.idx, max(CASE WHEN n.hit = p.idx THEN 1 ELSE 0 END) AS is_match, {d.ordered_join("CAST(n.hit AS VARCHAR(12))", "n.hit", ",")} AS context_for FROM paras p JOIN near n ON n.doc_id = p.doc_id AND n.idx = p.idx GROUP BY p.doc_id, p.idx"""


@query
def para_range(d):
    """Paragraphs 2 to 4."""
    return f"{paras(d)} SELECT doc_id, idx, text FROM paras WHERE idx BETWEEN 2 AND 4"


@query
def para_skip_empty(d):
    """Paragraphs that hold more than white space."""
    return f"{paras(d)} SELECT doc_id, idx FROM norms WHERE norm <> ''"


@query
def alternate_view_hint(d):
    """Conversations without a match in the accepted view (users' turns), and how many the other view has."""
    return """SELECT conv_id, CAST(sum(CASE WHEN role <> 'user' AND contains(lower(text), 'an') THEN 1 ELSE 0 END) AS BIGINT) AS other_view_matches FROM conversations
    GROUP BY conv_id HAVING sum(CASE WHEN role = 'user' AND contains(lower(text), 'an') THEN 1 ELSE 0 END) = 0"""


@query
def block_counts(d):
    """Paragraphs of each class by document."""
    kind = f"CASE WHEN norm = '' THEN 'blank' WHEN {d.matches('norm', '^#{1,9} ')} THEN 'heading' WHEN norm LIKE '|%|' THEN 'table' WHEN {d.matches('text', '^ *' + MARKER + ' ')} THEN 'list' ELSE 'paragraph' END"
    return f"{paras(d)}, k AS (SELECT doc_id, {kind} AS kind FROM norms) SELECT doc_id, kind, count(*) AS n FROM k GROUP BY doc_id, kind"


@query
def marker_parse(d):
    """List markers at the start of paragraphs."""
    return f"{paras(d)} SELECT doc_id, idx, {d.extract('text', '^ *(' + MARKER + ') ', 1)} AS marker FROM paras WHERE {d.matches('text', '^ *' + MARKER + ' ')}"


MARKERS = "(VALUES (1, '1. a'), (2, '2.1. b'), (3, '(a) c'), (4, 'iv. d'), (5, 'C. e'), (6, '- f'), (7, '12) g'), (8, 'plain'), (9, '  * h'), (10, '(iv) i'), (11, 'x. j')) AS t(id, line)"


@query
def marker_style(d):
    """Kinds of markers; a lone lower-case i, v, x, l, c, d or m counts as roman."""
    return f"""SELECT id, CASE WHEN {d.matches('line', '^ *[-*+] ')} THEN 'bullet' WHEN {d.matches('line', '^ *[0-9]+([.][0-9]+)+[.]? ')} THEN 'outline' WHEN {d.matches('line', '^ *[0-9]+[.)] ')} THEN 'decimal'
    WHEN {d.matches('line', '^ *[(]?[ivxlcdm]+[.)] ')} THEN 'lowerRoman' WHEN {d.matches('line', '^ *[(]?[IVXLCDM]{2,}[.)] ')} THEN 'upperRoman' WHEN {d.matches('line', '^ *[(]?[a-z][.)] ')} THEN 'lowerLetter'
    WHEN {d.matches('line', '^ *[(]?[A-Z][.)] ')} THEN 'upperLetter' ELSE 'none' END AS style FROM {MARKERS}"""


@query
def reference_parse(d):
    """Paragraph references such as P12 and [P12.3]; zero and other text give none."""
    rows = "(VALUES (1, 'P12'), (2, '[P12.3]'), (3, '0'), (4, 'x'), (5, '7'), (6, '[p4]')) AS t(id, ref)"
    return f"SELECT id, nullif(CAST(nullif({d.extract('upper(ref)', r'^\[?P?([0-9]+)([.][0-9]+)?\]?$', 1)}, '') AS INT), 0) AS idx FROM {rows}"


@query
def md_table_cells(d):
    """Cells of pipe tables; separator rows are left out."""
    rows = "(VALUES (1, 1, '| a | b |'), (1, 2, '|---|---|'), (1, 3, '| c | d |'), (2, 1, '| x |'), (2, 2, '| - |'), (2, 3, '| y | z |')) AS t(tbl, line, txt)"
    cell = lambda k: f"trim(BOTH ' ' FROM {d.item(('split(txt, r' + chr(39) + '[|]' + chr(39) + ')') if d.spark else 'string_split(txt, ' + chr(39) + '|' + chr(39) + ')', str(k))})"
    width = "length(txt) - length(replace(txt, '|', '')) - 1"
    return f"SELECT tbl, line, {width} AS width, {cell(2)} AS first_cell, CASE WHEN {width} > 1 THEN {cell(3) if not d.spark else cell(3).replace('element_at', 'try_element_at')} END AS second_cell FROM {rows} WHERE NOT {d.matches('txt', '^[|]( *:?-+:? *[|])+$')}"


# --- targeting ----------------------------------------------------------------


@query
def duplicate_paragraphs(d):
    """Texts that several paragraphs of the corpus share."""
    return f"{paras(d)} SELECT norm, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM norms WHERE norm <> '' GROUP BY norm HAVING count(*) > 1"


@query
def target_ambiguous(d):
    """Texts that stand more than once in a document, with the candidates."""
    return f"{paras(d)} SELECT doc_id, norm, {d.ordered_join('CAST(idx AS VARCHAR(12))', 'idx', ',')} AS candidates FROM norms WHERE norm <> '' GROUP BY doc_id, norm HAVING count(*) > 1"


@query
def target_strict(d):
    """Paragraphs equal to a passage; equality of the trimmed text ranks before that of the normalised."""
    return f"""{paras(d)}, targets AS (SELECT item_id, text AS wanted, {d.normalised('text')} AS norm FROM benchmark),
    hits AS (SELECT t.item_id, n.doc_id, n.idx, CASE WHEN trim(BOTH ' ' FROM n.text) = trim(BOTH ' ' FROM t.wanted) THEN 1 ELSE 2 END AS tier FROM targets t JOIN norms n ON n.norm = t.norm)
    SELECT item_id, doc_id, idx, tier FROM (SELECT *, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY tier, idx) AS place FROM hits) h WHERE place = 1"""


@query
def target_occurrence(d):
    """The second paragraph of those of one text in a document."""
    return f"{paras(d)} SELECT doc_id, norm, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY idx) AS occurrence FROM norms WHERE norm <> '') o WHERE occurrence = 2"


@query
def target_nearest_index(d):
    """Drift repair: of a document's paragraphs of one text, the nearest to index 3."""
    return f"{paras(d)} SELECT doc_id, norm, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY abs(idx - 3), idx) AS place FROM norms WHERE norm <> '') o WHERE place = 1"


@query
def target_fuzzy_overlap(d):
    """Best paragraph of each passage by word overlap above 0.5; words meet by an equi-join."""
    return f"""{paras(d)}, targets AS (SELECT item_id, {d.normalised('text')} AS norm FROM benchmark),
    wanted AS (SELECT DISTINCT item_id, word FROM ({d.words('targets', 'item_id')}) x), sizes AS (SELECT item_id, count(*) AS size FROM wanted GROUP BY item_id),
    own AS (SELECT doc_id, idx, word, count(*) AS times FROM ({d.words('norms', 'doc_id, idx')}) y GROUP BY doc_id, idx, word),
    score AS (SELECT w.item_id, o.doc_id, o.idx, sum(o.times) AS hits FROM wanted w JOIN own o ON o.word = w.word GROUP BY w.item_id, o.doc_id, o.idx),
    ranked AS (SELECT s.item_id, s.doc_id, s.idx, s.hits, z.size, row_number() OVER (PARTITION BY s.item_id ORDER BY s.hits DESC, s.doc_id, s.idx) AS place FROM score s JOIN sizes z ON z.item_id = s.item_id WHERE s.hits > 0.5 * z.size)
    SELECT item_id, doc_id, idx, CAST(hits AS BIGINT) AS hits, size FROM ranked WHERE place = 1"""


@query
def substring_replace_first(d):
    """First match of a phrase in any case, replaced."""
    at = f"{'instr' if d.spark else 'strpos'}(lower(text), 'the')"
    return f"SELECT doc_id, {at} AS at, concat(substring(text, 1, {at} - 1), 'THE', substring(text, {at} + 3)) AS replaced FROM documents WHERE {at} > 0"


@query
def localized_offsets(d):
    """Where replacements lie after all are applied: the running change of length."""
    rows = "(VALUES (1, 0, 3, 'abcd'), (1, 5, 5, 'xx'), (1, 9, 12, ''), (2, 4, 6, 'q')) AS t(op, s, e, put)"
    delta = "sum(length(put) - (e - s)) OVER (PARTITION BY op ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"SELECT op, s, e, CAST(s + coalesce({delta}, 0) AS INT) AS after_start, CAST(s + coalesce({delta}, 0) + length(put) AS INT) AS after_end FROM {rows}"


@query
def localized_conflicts(d):
    """Equal ranges with different text conflict; ranges that overlap do too, touching ones don't."""
    rows = "(VALUES (1, 0, 3, 'a'), (1, 0, 3, 'b'), (2, 0, 4, 'a'), (2, 3, 6, 'b'), (3, 0, 3, 'a'), (3, 3, 6, 'b'), (4, 1, 2, 'a'), (4, 1, 2, 'a')) AS t(op, s, e, put)"
    return f"""WITH own AS (SELECT DISTINCT op, s, e, put FROM {rows}), seen AS (SELECT *, lag(s) OVER (PARTITION BY op ORDER BY s, e, put) AS ps, lag(e) OVER (PARTITION BY op ORDER BY s, e, put) AS pe FROM own)
    SELECT op, s, e, CASE WHEN s = ps AND e = pe THEN 'CONFLICTING_PATCHES' ELSE 'OVERLAPPING_PATCHES' END AS code FROM seen WHERE s < pe"""


# --- numbering ------------------------------------------------------------------


@query
def list_blocks(d):
    """Runs of lines of one flag in an order, by gaps and islands."""
    return """WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS island FROM lineitem)
    SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS lines FROM k GROUP BY l_orderkey, l_returnflag, island"""


def roman(d: Dialect, n: str) -> str:
    digits = lambda one, five, ten: d.array("''", *[f"'{x}'" for x in (one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)])
    whole = lambda by: f"CAST(floor({n} / {by}.0) AS INT)"
    return f"concat(repeat('M', {whole(1000)}), {d.item(digits('C', 'D', 'M'), whole(100) + ' % 10 + 1')}, {d.item(digits('X', 'L', 'C'), whole(10) + ' % 10 + 1')}, {d.item(digits('I', 'V', 'X'), n + ' % 10 + 1')})"


@query
def roman_label(d):
    """Roman labels of 1 to 2000."""
    return f"WITH t AS ({d.number_rows(2000)}) SELECT n, {roman(d, 'n')} AS label FROM t"


@query
def alpha_label(d):
    """Letters in bijective base 26, up to two of them: z is followed by aa."""
    return f"WITH t AS ({d.number_rows(702)}) SELECT n, concat(CASE WHEN n > 26 THEN chr(CAST(96 + floor((n - 1) / 26.0) AS INT)) ELSE '' END, chr(CAST(97 + (n - 1) % 26 AS INT))) AS label FROM t"


@query
def list_labels(d):
    """Labels of an order's lines, by a counter for each order."""
    place = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber)"
    return f"WITH k AS (SELECT l_orderkey, l_linenumber, {place} AS n FROM lineitem) SELECT l_orderkey, l_linenumber, concat(CAST(n AS VARCHAR(12)), '.') AS decimal_label, lower({roman(d, 'n')}) AS roman_label FROM k"


@query
def header_inheritance(d):
    """The last value in force: an event without a purchase inherits the user's previous one."""
    value = "CASE WHEN event_type = 'purchase' THEN event_id END"
    last = f"last_value({value}) IGNORE NULLS" if d.spark else f"last_value({value} IGNORE NULLS)"
    return f"SELECT event_id, user_id, {last} OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_force FROM events"


# --- change data: turns are segments, the role is the author, every third turn a deletion -------

SEGMENTS = "WITH seg AS (SELECT conv_id, turn, role AS author, text, CASE turn % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'insertion' ELSE 'deletion' END AS kind FROM conversations)"


@query
def segments_views(d):
    """Accepted and rejected text of each conversation."""
    return f"{SEGMENTS} SELECT conv_id, {d.ordered_join('text', 'turn', ' ', 'kind <> ' + chr(39) + 'deletion' + chr(39))} AS accepted, {d.ordered_join('text', 'turn', ' ', 'kind <> ' + chr(39) + 'insertion' + chr(39))} AS rejected FROM seg GROUP BY conv_id"


@query
def segments_cursors(d):
    """Where a segment starts in either view; null where the view hides it."""
    start = lambda hidden: f"CASE WHEN kind <> '{hidden}' THEN CAST(coalesce(sum(CASE WHEN kind <> '{hidden}' THEN length(text) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) END"
    return f"{SEGMENTS} SELECT conv_id, turn, kind, {start('deletion')} AS accepted_start, {start('insertion')} AS rejected_start FROM seg"


@query
def accept_by_author(d):
    """Accepting one author's changes: their insertions turn baseline, their deletions go."""
    return f"{SEGMENTS} SELECT conv_id, turn, CASE WHEN lower(trim(author)) = 'user' THEN 'baseline' ELSE kind END AS kind FROM seg WHERE NOT (lower(trim(author)) = 'user' AND kind = 'deletion')"


@query
def reject_by_author(d):
    """Rejecting one author's changes: their insertions go, their deletions turn baseline."""
    return f"{SEGMENTS} SELECT conv_id, turn, CASE WHEN lower(trim(author)) = 'user' THEN 'baseline' ELSE kind END AS kind FROM seg WHERE NOT (lower(trim(author)) = 'user' AND kind = 'insertion')"


@query
def revision_authors(d):
    """Authors of changes, and whether any change has none."""
    return f"{SEGMENTS} SELECT conv_id, {d.sorted_set('author')} AS authors, max(CASE WHEN coalesce(author, '') = '' THEN 1 ELSE 0 END) AS unattributed FROM seg WHERE kind <> 'baseline' GROUP BY conv_id"


@query
def policy_auto(d):
    """Changes by others call for slicing, one's own for merging."""
    return f"{SEGMENTS} SELECT conv_id, CASE WHEN max(CASE WHEN kind <> 'baseline' AND lower(trim(coalesce(author, ''))) <> 'user' THEN 1 ELSE 0 END) = 1 THEN 'slice-cross-author' ELSE 'merge-same-author' END AS policy FROM seg GROUP BY conv_id"


@query
def comment_threads(d):
    """Replies with the comment that they answer."""
    return "SELECT c.conv_id, c.turn, p.turn AS parent_turn, p.role AS parent_author FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"


@query
def thread_closure(d):
    """Every reply's root and depth, to the fix-point."""
    return """WITH RECURSIVE t(conv_id, turn, root, depth) AS (SELECT conv_id, turn, turn, 0 FROM conversations WHERE turn % 4 = 0
    UNION ALL SELECT c.conv_id, c.turn, t.root, t.depth + 1 FROM t JOIN conversations c ON c.conv_id = t.conv_id AND c.turn = t.turn + 1 AND c.turn % 4 <> 0) SELECT conv_id, turn, root, depth FROM t"""


@query
def comment_anchor_text(d):
    """Text between an anchor's start (every fourth turn) and its end, two turns on."""
    return f"SELECT a.conv_id, a.turn AS anchor, {d.ordered_join('p.text', 'p.turn', '|')} AS anchored FROM conversations a JOIN conversations p ON p.conv_id = a.conv_id AND p.turn BETWEEN a.turn AND a.turn + 2 WHERE a.turn % 4 = 0 GROUP BY a.conv_id, a.turn"


# --- validation and verification --------------------------------------------------

ISSUES = "issues AS (SELECT doc_id, 'EMPTY_TEXT_ELEMENT' AS code FROM norms WHERE norm = '' UNION ALL SELECT doc_id, 'LONG_PARAGRAPH' AS code FROM norms WHERE length(norm) > 600)"


@query
def issue_summary(d):
    """Issues by code."""
    return f"{paras(d)}, {ISSUES} SELECT code, count(*) AS n, count(DISTINCT doc_id) AS docs FROM issues GROUP BY code"


@query
def validation_delta(d):
    """Issues of the output that its baseline (one document back) doesn't account for; repeats count."""
    return f"{paras(d)}, {ISSUES} SELECT doc_id, code FROM issues EXCEPT ALL SELECT doc_id + 1 AS doc_id, code FROM issues"


@query
def validation_duplicate_ids(d):
    """An issue for each repeat of an id within a document."""
    return "SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) AS repeat_no FROM lineitem) r WHERE repeat_no > 1"


@query
def marker_balance(d):
    """Starts without an end and ends without a start."""
    return "(SELECT o_orderkey AS id, 'NO_END' AS code FROM orders EXCEPT SELECT l_orderkey, 'NO_END' FROM lineitem WHERE l_linenumber >= 4) UNION ALL (SELECT l_orderkey, 'NO_START' FROM lineitem EXCEPT SELECT o_orderkey, 'NO_START' FROM orders WHERE o_orderstatus <> 'F')"


@query
def inspection_compare(d):
    """First ten differences between a document and the next, by position."""
    return f"""{paras(d)}, pairs AS (SELECT coalesce(a.doc_id, b.doc_id - 1) AS doc_id, coalesce(a.idx, b.idx) AS idx, CASE WHEN a.idx IS NULL THEN 'added' WHEN b.idx IS NULL THEN 'removed' WHEN a.norm <> b.norm THEN 'text' END AS path
    FROM norms a FULL OUTER JOIN norms b ON b.doc_id = a.doc_id + 1 AND b.idx = a.idx),
    found AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS place FROM pairs WHERE path IS NOT NULL) SELECT doc_id, idx, path FROM found WHERE place <= 10"""


@query
def fidelity_compare(d):
    """A differing count is the only violation; else texts by position, at most five."""
    return f"""{paras(d)}, counts AS (SELECT doc_id, count(*) AS n FROM norms GROUP BY doc_id), pairs AS (SELECT a.doc_id, a.n, b.n AS m FROM counts a JOIN counts b ON b.doc_id = a.doc_id + 1),
    texts AS (SELECT a.doc_id, a.idx, row_number() OVER (PARTITION BY a.doc_id ORDER BY a.idx) AS place FROM norms a JOIN norms b ON b.doc_id = a.doc_id + 1 AND b.idx = a.idx JOIN pairs c ON c.doc_id = a.doc_id WHERE c.n = c.m AND a.norm <> b.norm)
    SELECT doc_id, 0 AS idx, 'REJECT_PARAGRAPH_COUNT' AS code FROM pairs WHERE n <> m UNION ALL SELECT doc_id, idx, 'REJECT_TEXT' AS code FROM texts WHERE place <= 5"""


# --- batches: an order is a document, a line an operation -----------------------------

OPS = "WITH ops AS (SELECT l_orderkey AS doc_id, l_linenumber AS op, l_partkey % 3 AS para, CASE l_partkey % 4 WHEN 0 THEN 'comment' WHEN 1 THEN 'format' ELSE 'redline' END AS kind FROM lineitem)"


@query
def operation_order(d):
    """The stable order of operations that don't depend on each other: comments first, then by index."""
    return f"{OPS} SELECT doc_id, op, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'comment' THEN 0 ELSE 1 END, op) AS step FROM ops"


@query
def receipts_reconcile(d):
    """Receipts whose id the output lacks."""
    return "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R')"


@query
def retry_plan(d):
    """Indexes that were committed, failed, and not tried, by document."""
    pick = lambda f: d.ordered_join("CAST(l_linenumber AS VARCHAR(12))", "l_linenumber", ",", f"l_returnflag = '{f}'")
    return f"SELECT l_orderkey, {pick('A')} AS committed, {pick('R')} AS failed, {pick('N')} AS unattempted FROM lineitem GROUP BY l_orderkey"


@query
def revision_token(d):
    """SHA-256 over the framed id, length and text of a document."""
    return f"SELECT doc_id, {'sha2(' if d.spark else 'sha256('}concat(CAST(doc_id AS VARCHAR(20)), ':', CAST({'octet_length' if d.spark else 'strlen'}(text) AS VARCHAR(20)), ':', text){', 256' if d.spark else ''}) AS token FROM documents"


@query
def source_type(d):
    """Whether markup is a package, a document or a fragment, by its first tag."""
    return f"SELECT page_id, CASE WHEN {d.matches('html', '^ *<pkg:package')} THEN 'package' WHEN {d.matches('lower(html)', '^ *<(!doctype|html)')} THEN 'document' ELSE 'fragment' END AS source_type FROM pages"


# --- kernels ------------------------------------------------------------------------


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive turns of a conversation as two versions of one text."""
    c = read(spark, sf_dir, "conversations")
    old = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old"))
    return c.select("conv_id", "turn", F.col("text").alias("new")).join(old, ["conv_id", "turn"])


def word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference rows with offsets in the old text."""
    return diff_rows(turn_pairs(spark, sf_dir), "conv_id long, turn long")


def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference rows after semantic clean-up, with whole words as anchors."""
    return diff_rows(turn_pairs(spark, sf_dir), "conv_id long, turn long", lambda old, new: word_changes(old, new, semantic=True))


def headed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and the same with a word put in front, or with their first letter gone where the turn's number is odd."""
    c = read(spark, sf_dir, "conversations")
    new = F.when(F.col("turn") % 2 == 1, F.expr("substring(text, 2)")).otherwise(F.concat(F.lit("Well, "), "text"))
    return c.where("text <> ''").select("conv_id", "turn", F.col("text").alias("old"), new.alias("new"))


def char_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences by characters."""
    return diff_rows(headed_turns(spark, sf_dir), "conv_id long, turn long", char_diff)


def insertion_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose new version is the old one with insertions only, and how many characters are new."""
    rows = diff_rows(headed_turns(spark, sf_dir), "conv_id long, turn long", insertion_diff)
    return rows.groupBy("conv_id", "turn").agg(F.sum(F.when(F.col("type") == "insert", F.length("text")).otherwise(0)).alias("inserted"))


def markdown_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their marks, and how many marks there were; every third document is in bold, every fifth underlined."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"[*_~<&+\n]", " ").alias("text"))
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x **"), "text", F.lit("**"))).when(F.col("doc_id") % 5 == 0, F.concat(F.lit("++"), "text", F.lit("++ y"))).otherwise(F.col("text"))
    return markdown.stripped(docs.where("text <> ''").select("doc_id", marked.alias("text")), "doc_id long").select("doc_id", "clean", F.size("hints").alias("marks"))


def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of each order's lines as a batch: a line may use what an earlier line captures."""
    lines = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("op"),
        F.when(F.col("l_partkey") % 4 == 0, "comment").otherwise("redline").alias("kind"),
        F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("k"), F.col("l_linenumber"))).alias("made"),
        F.when((F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") > 1), F.concat(F.lit("k"), (F.floor(F.col("l_linenumber") / 2) * 2 - 1))).alias("used"),
        F.concat(F.lit("s"), F.col("l_linenumber")).alias("selector"),
    )
    return schedule.scheduled(lines)


def _rebuilt(left_out: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kept = word_diff(spark, sf_dir).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.when(F.col("type") != left_out, F.struct("seq", "text")))).alias("s"))
        return kept.select("conv_id", "turn", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"))

    return run


QUERIES |= {f.__name__: f for f in (semantic_diff, char_diffs, insertion_only, markdown_stripped, dependency_order)}
QUERIES |= {"word_diff": word_diff, "diff_reconstruct_old": _rebuilt("insert"), "diff_reconstruct_new": _rebuilt("delete")}
_PAIRS = "FROM conversations n JOIN conversations o ON o.conv_id = n.conv_id AND o.turn = n.turn - 1"
ORACLES |= {"diff_reconstruct_old": f"SELECT n.conv_id, n.turn, o.text {_PAIRS}", "diff_reconstruct_new": f"SELECT n.conv_id, n.turn, n.text {_PAIRS}"}
ORACLES |= {
    "insertion_only": "SELECT conv_id, turn, CAST(6 AS BIGINT) AS inserted FROM conversations WHERE text <> '' AND turn % 2 = 0",
    "markdown_stripped": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'x ' || t WHEN doc_id % 5 = 0 THEN t || ' y' ELSE t END AS clean, CAST(CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 1 ELSE 0 END AS INTEGER) AS marks
    FROM (SELECT doc_id, regexp_replace(text, '[*_~<&+\\n]', ' ', 'g') AS t FROM documents) WHERE t <> ''""",
}
