"""One description of an operator, as Spark SQL and as DuckDB SQL.

An operator's body is a function of a dialect, which spells what the two engines spell differently. Spark's text is planned by
Catalyst like any other SQL; DuckDB's is the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.functions.folding import accent_table
from quillspark.plans import registry

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rx(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to)})"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_like({x}, {self.lit(pattern)})"

    def all(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(pattern)}, 0)"

    def first(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, {self.lit(pattern)}, {group})"

    def n(self, x: str, pattern: str) -> str:
        return f"CAST(regexp_count({x}, {self.lit(pattern)}) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def split(self, x: str, sep: str) -> str:
        """Parts between occurrences of a literal separator."""
        return f"split({x}, {self.lit(chr(92) + 'Q' + sep + chr(92) + 'E')}, -1)"

    def fold(self, x: str) -> str:
        source, target = accent_table()
        return f"lower(translate({x}, {self.lit(source)}, {self.lit(target)}))"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def any(self, a: str, v: str, e: str) -> str:
        return f"exists({a}, {v} -> {e})"

    def distinct(self, a: str) -> str:
        return f"array_sort(array_distinct({a}))"

    def sorted(self, a: str) -> str:
        return f"array_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def at(self, a: str, k: str) -> str:
        return f"try_element_at({a}, CAST({k} AS INT))"

    def slice(self, a: str, start: str, count: str) -> str:
        return f"slice({a}, CAST({start} AS INT), CAST({count} AS INT))"

    def range(self, lo: str, hi: str) -> str:
        """lo to hi - 1; empty if hi <= lo."""
        return f"(CASE WHEN {hi} > {lo} THEN sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) - 1) ELSE array() END)"

    def without(self, a: str, b: str) -> str:
        return f"array_sort(array_except({a}, {b}))"

    def both(self, a: str, b: str) -> str:
        return f"array_sort(array_intersect({a}, {b}))"

    def within(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def contains(self, x: str, y: str) -> str:
        return f"contains({x}, {y})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def explode(self, source: str, columns: str, array: str, at: str, value: str, where: str = "") -> str:
        """Rows of columns, with place (from 0) and value of each element."""
        return f"SELECT {columns}, CAST({at} AS BIGINT) AS {at}, {value} FROM {source} LATERAL VIEW posexplode({array}) AS {at}, {value}{' WHERE ' + where if where else ''}"

    def collect(self, x: str, order: str) -> str:
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), s -> s.x)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def epoch(self, ts: str) -> str:
        return f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"

    def json(self, x: str, field: str) -> str:
        return f"get_json_object({x}, '$.{field}')"

    def argmax(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def struct(self, **x: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in x.items()) + ")"

    def ints(self, text: str) -> str:
        return f"CAST({text} AS BIGINT)"


class Duck(Spark):
    name = "duck"

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def rx(self, x: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({x}, {self.lit(pattern)}, {self.lit(to.replace('$', chr(92)))}, 'g')"

    def has(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, {self.lit(pattern)})"

    def n(self, x: str, pattern: str) -> str:
        return f"CAST(len(regexp_extract_all({x}, {self.lit(pattern)})) AS BIGINT)"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def fold(self, x: str) -> str:
        return f"lower(strip_accents({x}))"

    def map(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def any(self, a: str, v: str, e: str) -> str:
        return f"len(list_filter({a}, lambda {v}: {e})) > 0"

    def distinct(self, a: str) -> str:
        return f"list_sort(list_distinct({a}))"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def join(self, a: str, sep: str) -> str:
        return f"coalesce(array_to_string({a}, {self.lit(sep)}), '')"

    def at(self, a: str, k: str) -> str:
        return f"list_extract({a}, CAST({k} AS BIGINT))"

    def slice(self, a: str, start: str, count: str) -> str:
        return f"list_slice({a}, CAST({start} AS BIGINT), CAST({start} AS BIGINT) + CAST({count} AS BIGINT) - 1)"

    def range(self, lo: str, hi: str) -> str:
        return f"range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))"

    def without(self, a: str, b: str) -> str:
        return f"list_sort(list_distinct(list_filter({a}, lambda q: NOT list_contains({b}, q))))"

    def both(self, a: str, b: str) -> str:
        return f"list_sort(list_intersect({a}, {b}))"

    def within(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def explode(self, source: str, columns: str, array: str, at: str, value: str, where: str = "") -> str:
        inner = f"SELECT {columns}, unnest(range(len({array}))) AS {at}, unnest({array}) AS {value} FROM {source}"
        return f"SELECT * FROM ({inner}){' WHERE ' + where if where else ''}"

    def collect(self, x: str, order: str) -> str:
        return f"list({x} ORDER BY {order})"

    def sha(self, x: str) -> str:
        return f"sha256({x})"

    def epoch(self, ts: str) -> str:
        return f"CAST(floor(epoch_us({ts}) / 1000000) AS BIGINT)"

    def json(self, x: str, field: str) -> str:
        return f"json_extract_string({x}, '$.{field}')"

    def argmax(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def struct(self, **x: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in x.items()) + "}"


SPARK, DUCK = Spark(), Duck()
Body = Callable[[Spark], str]


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL over the driver's tables. Those that the text names are relations of the query itself; so no view of the session's is made or replaced."""
    named = [name for name in TABLES if f" {name}" in text or f"({name}" in text]
    own = ", ".join(f"{name} AS (SELECT * FROM parquet.`{sf_dir}/{name}.parquet`)" for name in named)
    start, rest = re.match(r"(?s)\s*(WITH\s+RECURSIVE\s|WITH\s)?(.*)", text).groups()
    return spark.sql(f"{start or 'WITH '}{own}{', ' if start else ' '}{rest}" if own else text)


def operator(name: str, body: Body, oracle: bool = True) -> None:
    """Registers an operator's query, and DuckDB's text of it."""
    text = body(SPARK)
    registry.QUERIES[name] = lambda spark, sf_dir: run_sql(spark, sf_dir, text)
    if oracle:
        registry.ORACLES[name] = body(DUCK)


def oracle(name: str, body: Body) -> None:
    """Registers DuckDB's text of an operator whose query is a plan of its own (``plans.frames``)."""
    registry.ORACLES[name] = body(DUCK)


# --- relations over the driver's tables that several operators read ---


def lines(d: Spark) -> str:
    """Lines of documents: doc_id, lang, source, ord, line."""
    return "lines AS (" + d.explode("documents", "doc_id, lang, source", d.split("coalesce(text, '')", "\n"), "ord", "line") + ")"


def page_lines(d: Spark) -> str:
    """Documents as pages of a book (their source): two of three begin with the book's running head, all end with their number. Lines that are
    not blank, with their place from the page's top and from its end (from 1)."""
    return (
        """paged AS (SELECT doc_id, lang, source, concat(CASE WHEN doc_id % 3 > 0 THEN concat('The Book of ', source, ', ', CAST(doc_id AS STRING)) ELSE 'Of another thing' END, chr(10), coalesce(text, ''), chr(10), CAST(doc_id AS STRING)) AS text FROM documents), all_lines AS ("""
        + d.explode("paged", "doc_id, lang, source", d.split("text", "\n"), "ord", "line")
        + "), page_lines AS (SELECT doc_id, source, ord, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS up, row_number() OVER (PARTITION BY doc_id ORDER BY ord DESC) AS down FROM all_lines WHERE trim(line) <> '')"
    )


def pairs(d: Spark) -> str:
    """Source and output texts: each turn of a conversation and its answer."""
    return "pairs AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS out FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def items(d: Spark) -> str:
    """Work items of a job: conversations as jobs and turns as items, with outcomes that follow from their numbers."""
    return """items AS (SELECT conv_id AS job, turn AS k, text AS source_text,
      CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS proposal,
      CASE WHEN turn % 5 = 4 OR (conv_id + turn) % 4 = 3 THEN NULL WHEN (conv_id + turn) % 4 = 0 THEN 0 ELSE 1 END AS audit_ok,
      CASE WHEN (conv_id + turn) % 3 = 0 THEN '["size"]' WHEN (conv_id + turn) % 3 = 1 THEN '[]' ELSE NULL END AS checks,
      CASE WHEN (conv_id + turn) % 4 = 0 AND turn % 5 <> 4 AND conv_id % 3 > 0 THEN concat(text, '.') ELSE NULL END AS revised,
      CASE WHEN (conv_id + turn) % 4 = 0 AND turn % 5 <> 4 AND conv_id % 3 > 0 THEN turn % 2 ELSE NULL END AS audit2_ok,
      CASE WHEN conv_id % 2 = 0 THEN '["number"]' ELSE '[]' END AS checks2,
      CASE WHEN (conv_id + turn) % 4 = 0 AND conv_id % 5 = 1 THEN concat(text, '!') ELSE NULL END AS judged,
      CASE WHEN (conv_id + turn) % 4 = 0 THEN CASE conv_id % 4 WHEN 0 THEN '{"winner": "translator"}' WHEN 1 THEN '{"winner": "auditor"}' WHEN 2 THEN '{"winner": "user"}' ELSE NULL END ELSE NULL END AS verdict,
      CASE WHEN turn % 3 = 0 THEN 'approved' WHEN turn % 3 = 1 THEN 'review' ELSE 'waiting' END AS state,
      CAST(length(text) AS BIGINT) AS seconds
    FROM conversations)"""


def blocks(d: Spark) -> str:
    """Blocks of books: a document's non-blank lines; the first is a heading, every fifth opens a page."""
    return lines(d) + """, blocks AS (SELECT doc_id, ord, concat('b', lpad(CAST(ord AS STRING), 5, '0')) AS id, line AS text,
      CASE WHEN ord = 0 THEN 'heading' ELSE 'paragraph' END AS kind, CAST(floor(ord / 5) + 1 AS BIGINT) AS page FROM lines WHERE trim(line) <> '')"""


def draft(d: Spark) -> str:
    """Draft blocks: documents with their labels; status and acceptance follow from labels and number."""
    return """draft AS (SELECT d.doc_id, d.source AS book, d.text AS result, CASE WHEN d.doc_id % 7 = 0 THEN concat(d.text, ' (edited)') WHEN d.doc_id % 11 = 0 THEN '' ELSE NULL END AS edited,
      CASE WHEN l.quality IS NULL THEN 'running' WHEN l.quality = 0 THEN 'review' WHEN l.toxic = 1 THEN 'judge' ELSE 'approved' END AS status,
      coalesce(l.quality = 1 AND d.doc_id % 2 = 0, false) AS accepted, d.doc_id % 10 = 0 AS automatic, CASE WHEN d.doc_id % 13 = 0 THEN 'image' WHEN d.doc_id % 5 = 0 THEN 'heading' ELSE 'paragraph' END AS kind
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def with_(*relations: str) -> str:
    return "WITH " + ", ".join(relations) + " "


def roman(d, n: str) -> str:
    """A Roman numeral by decimal places; empty outside 1 to 3999."""
    place = lambda k, one, five, ten: f"CASE {k} WHEN 1 THEN '{one}' WHEN 2 THEN '{one * 2}' WHEN 3 THEN '{one * 3}' WHEN 4 THEN '{one}{five}' WHEN 5 THEN '{five}' WHEN 6 THEN '{five}{one}' WHEN 7 THEN '{five}{one * 2}' WHEN 8 THEN '{five}{one * 3}' WHEN 9 THEN '{one}{ten}' ELSE '' END"
    digit = lambda unit: f"CAST(floor({n} / {unit}) AS BIGINT) % 10"
    return f"CASE WHEN {n} BETWEEN 1 AND 3999 THEN concat(repeat('M', CAST(floor({n} / 1000) AS INT)), {place(digit(100), 'C', 'D', 'M')}, {place(digit(10), 'X', 'L', 'C')}, {place(digit(1), 'I', 'V', 'X')}) ELSE '' END"
