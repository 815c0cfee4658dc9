import pytest

from redquill.operators import validation
from redquill.operators.markup import WORD

WHO = 'w:id="{}" w:author="a" w:date="2020-01-01T00:00:00Z"'


def part(inner):
    return f'<w:document xmlns:w="{WORD}"><w:body>{inner}</w:body></w:document>'.encode()


def rev(kind, number, inner):
    return f"<w:{kind} {WHO.format(number)}>{inner}</w:{kind}>"


RUN, GONE = "<w:r><w:t>a</w:t></w:r>", "<w:r><w:delText>a</w:delText></w:r>"


@pytest.mark.parametrize(
    "inner, codes",
    [
        (f"<w:p>{RUN}</w:p><w:sectPr/>", []),
        (f"<w:p>{rev('ins', 1, RUN)}{rev('del', 2, GONE)}</w:p>", []),
        (f"<w:p><w:r><w:p>{RUN}</w:p></w:r></w:p>", ["NESTED_PARAGRAPH"]),
        ("<w:sectPr/><w:p/><w:sectPr/>", ["MULTIPLE_BODY_SECTPR"]),
        ("<w:sectPr/><w:p/>", ["SECTPR_NOT_LAST"]),
        (f"<w:p>{rev('ins', 1, rev('del', 2, GONE))}</w:p>", []),
        (f"<w:p>{rev('del', 1, rev('ins', 2, GONE))}</w:p>", ["NESTED_REVISION"]),
        (f"<w:p>{rev('ins', 1, '<w:x>' + rev('del', 2, GONE) + '</w:x>')}</w:p>", ["NESTED_REVISION"]),
        (f"<w:p>{rev('del', 1, RUN)}</w:p>", ["DEL_CONTAINS_T"]),
        (f'<w:p><w:ins w:id="1" w:author="a">{RUN}</w:ins></w:p>', ["MISSING_REVISION_METADATA"]),
        (f"<w:p>{rev('ins', 1, RUN)}{rev('del', 1, GONE)}{rev('ins', 1, RUN)}</w:p>", ["DUPLICATE_REVISION_ID"] * 2),
        ("<w:p><w:r><w:t> a</w:t></w:r></w:p>", ["MISSING_SPACE_PRESERVE"]),
        ('<w:p><w:r><w:t xml:space="preserve"> a</w:t><w:t/></w:r></w:p>', ["EMPTY_TEXT_ELEMENT"]),
        (f"<w:p><w:pPr><w:rPr>{rev('ins', 1, '')}</w:rPr></w:pPr>{rev('ins', 2, '')}</w:p>", ["EMPTY_REVISION_WRAPPER"]),
    ],
)
def test_rules(inner, codes):
    assert validation.issues_of(part(inner)) == codes


def test_issue_rows_and_what_was_added(spark):
    bad = part(f"<w:p>{rev('del', 1, RUN)}{rev('del', 1, GONE)}<w:r><w:t/></w:r></w:p>")
    table = lambda *rows: validation.issues(spark.createDataFrame(rows, "doc_id long, payload binary"), "doc_id long")
    before, after = table((1, part("<w:p><w:r><w:t/></w:r></w:p>")), (2, b"<a"), (3, None)), table((1, bad), (2, b"<a"), (3, part("<w:p/>")))
    assert sorted(tuple(r) for r in before.collect()) == [(1, 1, "EMPTY_TEXT_ELEMENT", "warning"), (2, 1, "PARSE_ERROR", "error"), (3, 1, "PARSE_ERROR", "error")]
    got = sorted(tuple(r) for r in validation.added_issues(before, after, ["doc_id"]).collect())
    assert got == [(1, "DEL_CONTAINS_T", "error", 1), (1, "DUPLICATE_REVISION_ID", "error", 1)]
