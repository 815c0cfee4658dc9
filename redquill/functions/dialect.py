"""Spellings of the same expression in Spark SQL and in the oracle's SQL."""

from __future__ import annotations

from dataclasses import dataclass

# The white space that the document model's trimming and collapsing know.
WHITE_SPACE = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
# List markers at the start of a line, and the typed grammar for numbered markers.
MARKER = r"(?:[0-9]+(?:\.[0-9]+)*\.?|\((?:[0-9]+|[a-zA-Z]|[ivxlcIVXLC]+)\)|[a-zA-Z]\.|[0-9]+\.|[ivxlcIVXLC]+\.|[-*+\x{2022}])"
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def pattern(self, p: str) -> str:
        return ("r'" if self.spark else "'") + p + "'"

    def replace(self, text: str, p: str, by: str) -> str:
        return f"regexp_replace({text}, {self.pattern(p)}, '{by}'" + (")" if self.spark else ", 'g')")

    def extract(self, text: str, p: str, group: int) -> str:
        return f"regexp_extract({text}, {self.pattern(p)}, {group})"

    def matches(self, text: str, p: str) -> str:
        return f"({text} RLIKE {self.pattern(p)})" if self.spark else f"regexp_matches({text}, {self.pattern(p)})"

    def extract_all(self, text: str, p: str) -> str:
        return f"regexp_extract_all({text}, {self.pattern(p)}, 0)"

    def normalised(self, text: str) -> str:
        return f"trim(BOTH ' ' FROM {self.replace(text, WHITE_SPACE + '+', ' ')})"

    def fnv(self, text: str) -> str:
        """FNV-1a over code points, which are the 16-bit units below the astral planes."""
        if self.spark:
            fold = f"aggregate(split({text}, ''), {FNV_OFFSET}L, (h, c) -> ((h ^ CAST(ascii(c) AS BIGINT)) * {FNV_PRIME}L) & 4294967295L)"
            return f"concat('fnv1a32:', lpad(lower(hex({fold})), 8, '0'))"
        steps = f"list_concat([CAST({FNV_OFFSET} AS BIGINT)], list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT)))"
        fold = f"list_reduce({steps}, lambda h, c: (xor(h, c) * {FNV_PRIME}) & 4294967295)"
        return f"concat('fnv1a32:', lpad(lower(to_hex({fold})), 8, '0'))"

    def ordered_join(self, value: str, order: str, separator: str, where: str = "TRUE") -> str:
        """Values of a group joined in the order of a unique column."""
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v)) FILTER (WHERE {where})), x -> x.v), '{separator}')"
        return f"coalesce(string_agg({value}, '{separator}' ORDER BY {order}) FILTER (WHERE {where}), '')"

    def sorted_set(self, value: str) -> str:
        return f"array_join(array_sort(collect_set({value})), ',')" if self.spark else f"array_to_string(list_sort(list_distinct(list({value}))), ',')"

    def paragraphs(self) -> str:
        """Lines of documents; a null text is empty, one empty line."""
        if self.spark:
            return r"SELECT doc_id, CAST(p + 1 AS INT) AS idx, text FROM (SELECT doc_id, posexplode(split(coalesce(text, ''), '\n')) AS (p, text) FROM documents)"
        return "SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS idx, unnest(l) AS text FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"

    def words(self, source: str, columns: str) -> str:
        """A row for each word of ``norm`` that is longer than two characters."""
        return f"SELECT {columns}, word FROM (SELECT {columns}, " + ("explode(split(lower(norm), ' '))" if self.spark else "unnest(string_split(lower(norm), ' '))") + f" AS word FROM {source}) w WHERE length(word) > 2"

    def array(self, *items: str) -> str:
        return ("array(" if self.spark else "[") + ", ".join(items) + (")" if self.spark else "]")

    def item(self, array: str, place: str) -> str:
        """An array's item, from 1."""
        return f"element_at({array}, CAST({place} AS INT))" if self.spark else f"({array})[{place}]"

    def number_rows(self, most: int) -> str:
        return f"SELECT explode(sequence(1, {most})) AS n" if self.spark else f"SELECT unnest(range(1, {most + 1})) AS n"


SPARK, ORACLE = Dialect(True), Dialect(False)
