import pytest

from redquill.functions.dialect import SPARK
from redquill.operators import numbering
from redquill.operators.markup import WORD
from redquill.plans import catalogue


def part(inner):
    return f'<w:numbering xmlns:w="{WORD}" xmlns:m="urn:m">{inner}</w:numbering>'.encode()


LEVEL = '<w:lvl w:ilvl="{}"><w:start w:val="{}"/><w:numFmt w:val="{}"/><w:lvlText w:val="{}"/></w:lvl>'
ABSTRACT = f'<w:abstractNum w:abstractNumId="0">{LEVEL.format(0, 2, "decimal", "%1.")}{LEVEL.format(1, 1, "lowerLetter", "%1.%2")}<m:lvl w:ilvl="7"/></w:abstractNum>'
NUM = '<w:num w:numId="{}"><w:abstractNumId w:val="{}"/>{}</w:num>'
PARAS = "doc_id long, idx int, num_id string, ilvl int"


def found(spark, *parts):
    return numbering.entries(spark.createDataFrame([(i, p, "x") for i, p in enumerate(parts)], "doc_id long, payload binary, `a.b` string"), "doc_id long")


def test_levels_with_overrides_and_repeats(spark):
    whole = f'<w:lvlOverride w:ilvl="1">{LEVEL.format(1, 4, "upperRoman", "(%2)")}</w:lvlOverride>'
    start = f'<w:lvlOverride w:ilvl="0"><w:startOverride w:val="9"/>{LEVEL.format(0, 3, "bullet", "*")}</w:lvlOverride>'
    again = f'<w:abstractNum w:abstractNumId="0">{LEVEL.format(0, 8, "none", "no")}</w:abstractNum>' + NUM.format(1, 5, "")
    got = numbering.levels(found(spark, part(ABSTRACT + NUM.format(1, 0, "") + NUM.format(2, 0, whole) + NUM.format(3, 0, start) + NUM.format(4, 6, "") + again)), ["doc_id"]).collect()
    assert sorted(tuple(r)[1:] for r in got) == [
        ("1", 0, 2, "decimal", "%1."), ("1", 1, 1, "lowerLetter", "%1.%2"), ("2", 0, 2, "decimal", "%1."), ("2", 1, 4, "upperRoman", "(%2)"), ("3", 0, 9, "bullet", "*"), ("3", 1, 1, "lowerLetter", "%1.%2"),
    ]


def test_references(spark):
    rows = found(spark, part(ABSTRACT + NUM.format(1, 0, "") + NUM.format(2, 5, "")), b"<broken", None)
    paras = [(0, 1, "1", None), (0, 2, "1", 1), (0, 3, "1", 2), (0, 4, "2", 0), (0, 5, "7", 0), (0, 6, "0", 0), (0, 7, None, 0), (1, 1, "1", 0), (2, 1, "1", 0), (0, 5, "7", 0)]
    got = numbering.broken_references(spark.createDataFrame(paras, PARAS), rows, ["doc_id"]).collect()
    want = [(0, 3, "1", "LEVEL_MISSING"), (0, 4, "2", "ABSTRACT_MISSING"), (0, 5, "7", "NUM_MISSING"), (0, 5, "7", "NUM_MISSING"), (1, 1, "1", "NUM_MISSING"), (2, 1, "1", "NUM_MISSING")]
    assert sorted(map(tuple, got)) == want
    assert [r.error for r in rows.where("error IS NOT NULL").collect()] == ["PARSE_ERROR"]
    assert numbering.broken_references(spark.createDataFrame([], PARAS), found(spark, part("")), ["doc_id"]).count() == 0


def test_document_types_are_refused():
    with pytest.raises(ValueError, match="DTD_REFUSED"):
        numbering.read_numbering(b"<!DOCTYPE a><a/>")


def test_a_null_text_is_one_empty_line(spark):
    docs = spark.createDataFrame([(1, None), (2, "a\nb")], "doc_id long, text string")
    assert sorted(map(tuple, catalogue.over(spark, SPARK.paragraphs(), {"documents": docs}).collect())) == [(1, 1, ""), (2, 1, "a"), (2, 2, "b")]
