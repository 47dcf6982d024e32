"""Tables of the library's shapes, derived from the given ones by SQL that DuckDB runs too.

Files are suppliers; a file's lines are classes of order keys, numbered densely; its bindings are
line items. ``{table}`` stands for a given table. Columns that SQL dialects reserve have other
names in the SQL: ``col`` is ``column``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.storage import broadcast_by_measure, materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

_LETTER = "chr(CAST(97 + l_partkey % 26 AS INT))"
ITEMS = f"""
    SELECT 'f' || CAST(l_suppkey AS STRING) AS path, 'scope_' || CAST(l_linenumber % 4 AS STRING) AS scope_id,
        CASE l_linenumber % 5
            WHEN 0 THEN {_LETTER}
            WHEN 1 THEN {_LETTER} || CAST(l_partkey % 10 AS STRING)
            WHEN 2 THEN {_LETTER} || '__u' || CAST(l_partkey % 7 + 1 AS STRING)
            WHEN 3 THEN 'value' || CAST(l_partkey % 40 AS STRING)
            ELSE {_LETTER} || chr(CAST(97 + l_suppkey % 26 AS INT)) END AS name,
        CAST(dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 200) - 1 AS INT) AS line,
        CAST(l_partkey % 37 AS INT) AS col,
        CASE l_returnflag WHEN 'A' THEN 'variable' WHEN 'N' THEN 'function' ELSE 'parameter' END AS binding_type,
        CAST(l_quantity AS INT) AS quantity, l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS k3, l_discount AS k4, l_tax AS k5, l_shipdate AS k6
    FROM {{lineitem}}"""
BINDINGS = f"""
    SELECT path, scope_id, CAST(row_number() OVER (PARTITION BY path ORDER BY line, col, name, binding_type, scope_id, k1, k2, k3, k4, k5, k6) AS INT) AS binding_seq,
        name, line, col, binding_type, quantity FROM ({ITEMS}) i"""
LINES = f"""
    SELECT path, line, CASE binding_type
            WHEN 'variable' THEN 'var ' || name || ' = ' || CAST(quantity AS STRING) || ';'
            WHEN 'function' THEN 'function ' || name || '(a, b) {{{{'
            ELSE '  return ' || name || ' + x.' || name || ' * a;' END AS text
    FROM (SELECT path, line, name, binding_type, quantity, row_number() OVER (PARTITION BY path, line ORDER BY binding_seq) AS r FROM ({BINDINGS}) b) t WHERE r = 1"""
# a reference stands two lines below every third binding, and on its own line for every fourth
REFERENCES = f"""
    SELECT path, name, line, col, line + 2 AS ref_line FROM ({BINDINGS}) b WHERE binding_seq % 3 = 0
    UNION ALL SELECT path, name, line, col, line AS ref_line FROM ({BINDINGS}) b WHERE binding_seq % 4 = 0
    UNION ALL SELECT path, name, line, col, line + 7 AS ref_line FROM ({BINDINGS}) b WHERE binding_seq % 6 = 0"""
_SPAN = f"SELECT path, CAST(max(line) AS INT) AS z FROM ({LINES}) l GROUP BY path"
SCOPES = f"""
    SELECT path, 'scope_0' AS scope_id, 0 AS scope_seq, 'program' AS scope_type, 0 AS start_row, z AS end_row, CAST(NULL AS STRING) AS parent_id FROM ({_SPAN}) s
    UNION ALL SELECT path, 'scope_1', 1, 'function', 5, least(30, z), 'scope_0' FROM ({_SPAN}) s
    UNION ALL SELECT path, 'scope_2', 2, 'block', 8, least(20, z), 'scope_1' FROM ({_SPAN}) s
    UNION ALL SELECT path, 'scope_3', 3, CASE WHEN z % 2 = 0 THEN 'arrow' ELSE 'class' END, 40, least(160, z), 'scope_0' FROM ({_SPAN}) s"""
#: Smaller scopes, in which names differ: every four lines are two functions, one with a block.
FINE_BINDINGS = f"""
    SELECT path, CASE WHEN scope_id = 'scope_0' THEN scope_id ELSE scope_id || '_' || CAST(CAST(floor(line / 4) AS INT) AS STRING) END AS scope_id,
        binding_seq, name, line, col, binding_type, quantity FROM ({BINDINGS}) b"""
_CUT = f"""
    SELECT path, CAST(CAST(floor(line / 4) AS INT) AS STRING) AS k, CAST(floor(line / 4) AS INT) % 2 AS odd, min(line) AS start_row, max(line) AS end_row
    FROM ({LINES}) l GROUP BY path, CAST(floor(line / 4) AS INT)"""
FINE_SCOPES = f"""
    SELECT path, 'scope_0' AS scope_id, 'program' AS scope_type, 0 AS start_row, z AS end_row, CAST(NULL AS STRING) AS parent_id FROM ({_SPAN}) s
    UNION ALL SELECT path, 'scope_1_' || k, 'function', start_row, end_row, 'scope_0' FROM ({_CUT}) c
    UNION ALL SELECT path, 'scope_2_' || k, 'block', start_row, end_row, 'scope_1_' || k FROM ({_CUT}) c
    UNION ALL SELECT path, 'scope_3_' || k, CASE WHEN odd = 0 THEN 'arrow' ELSE 'class' END, start_row, end_row, 'scope_0' FROM ({_CUT}) c"""
#: Scopes that nest deeper: a customer's orders by date, each below the one of half its number.
TREE = """
    SELECT 'c' || CAST(o_custkey AS STRING) AS path, 's' || CAST(n AS STRING) AS scope_id, CASE WHEN n > 1 THEN 's' || CAST(floor(n / 2) AS INT) END AS parent_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'function' WHEN '2-HIGH' THEN 'class' WHEN '3-MEDIUM' THEN 'arrow' WHEN '5-LOW' THEN 'catch' ELSE 'block' END AS scope_type
    FROM (SELECT o_custkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS n FROM {orders}) o"""
TREE = TREE.replace("CAST(floor(n / 2) AS INT)", "CAST(CAST(floor(n / 2) AS INT) AS STRING)")
#: Names of all kinds, distinct.
NAMES = f"""
    SELECT DISTINCT name FROM (
        SELECT name FROM ({ITEMS}) i
        UNION ALL SELECT {_LETTER} || '_' || CAST(l_suppkey % 12 AS STRING) FROM {{lineitem}}
        UNION ALL SELECT lower(p_type) FROM (SELECT 'id__u' || CAST(p_partkey % 3 AS STRING) AS p_type FROM {{part}}) p
        UNION ALL SELECT CASE p_partkey % 14 WHEN 0 THEN 'face' WHEN 1 THEN 'abc' WHEN 2 THEN 'Set' WHEN 3 THEN 'aab' WHEN 4 THEN '' WHEN 5 THEN 'cafe12' WHEN 6 THEN 'ID' WHEN 7 THEN 'fn' WHEN 8 THEN 'If' WHEN 9 THEN 'src' WHEN 10 THEN 'constructor' WHEN 11 THEN ' padded ' WHEN 12 THEN '9lives' ELSE '$_' END FROM {{part}}) n"""
#: Renames as answers give them: the sixth part keyed by line, some names wanted twice or invalid.
RENAMES = f"""
    SELECT path, CAST(binding_seq AS BIGINT) AS seq, CASE WHEN binding_seq % 6 = 0 THEN name || ':' || CAST(line + 1 AS STRING) ELSE name END AS rename_key,
        CASE WHEN binding_seq % 11 = 0 THEN 'class' WHEN binding_seq % 13 = 0 THEN ' spaced' || CAST(quantity AS STRING) || ' ' WHEN binding_seq % 17 = 0 THEN '9' || name ELSE 'item' || CAST(quantity AS STRING) END AS new_name
    FROM ({BINDINGS}) b WHERE binding_seq % 5 <> 4"""
# What Spark runs for BINDINGS: the same rows, but a file's line items meet once, as they were given,
# and the strings are made behind the shuffle. ``first`` tells the first binding of a line.
_RAW = "l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate"
_RANK = "dense_rank() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey % 200)"
_PLACED = f"SELECT {_RAW}, {_RANK} AS place FROM {{lineitem}}"
_OWN_ITEMS = ITEMS.replace(_RANK, "place").replace("SELECT 'f'", "SELECT l_suppkey AS file, 'f'", 1).replace("{lineitem}", f"({_PLACED}) p")
_IN_FILE = "(PARTITION BY file ORDER BY line, col, name, binding_type, scope_id, k1, k2, k3, k4, k5, k6)"
BASE = f"""
    SELECT path, scope_id, CAST(row_number() OVER {_IN_FILE} AS INT) AS binding_seq, name, line, col, binding_type, quantity,
        coalesce(lag(line) OVER {_IN_FILE} <> line, true) AS first FROM ({_OWN_ITEMS}) i"""
DOC_LINES_DUCK = """SELECT CAST(doc_id AS VARCHAR) AS path, unnest(range(len(string_split(text, chr(10)))))::INT AS line, unnest(string_split(text, chr(10))) AS text FROM documents"""


def duck(sql: str) -> str:
    """The SQL for DuckDB, which knows the given tables by name."""
    return sql.format(**{t: t for t in TABLES})


class Tables:
    """The given tables of a folder, and what is derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        broadcast_by_measure(spark)
        self.spark, self.sf_dir = spark, sf_dir
        self.kept: dict[str, DataFrame] = {}

    def table(self, name: str, sql: str) -> DataFrame:
        """A derived table, written once a query: operators read bindings and lines many times."""
        if name not in self.kept:
            self.kept[name] = materialize(self.sql(sql), name)
        return self.kept[name]

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, sql: str) -> DataFrame:
        """Rows of the SQL; where it holds one of the tables below, what is written of it is read."""
        known = {"own_cut": (_CUT, self.cut), "own_span": (_SPAN, self.span), "own_lines": (LINES, self.lines), "own_bindings": (BINDINGS, self.rows)}
        frames = {}
        for name, (own, rows) in known.items():
            if f"({own})" in sql:
                sql, frames[name] = sql.replace(f"({own})", f"{{{name}}}"), rows()
        return self.spark.sql(sql, **frames, **{t: self.given(t) for t in TABLES if "{" + t + "}" in sql})

    def base(self) -> DataFrame:
        return self.table("base", BASE)

    def rows(self) -> DataFrame:
        """The rows of ``BINDINGS``."""
        return self.base().drop("first")

    def bindings(self) -> DataFrame:
        return self.rows().withColumnRenamed("col", "column")

    def lines(self) -> DataFrame:
        """The rows of ``LINES``: the text of a line's first binding, so nothing is shuffled."""
        text = LINES[LINES.index("CASE binding_type") : LINES.index("END AS text") + len("END AS text")]
        return self.spark.sql(f"SELECT path, line, {text} FROM {{base}} WHERE first", base=self.base())

    def span(self) -> DataFrame:
        return self.table("span", _SPAN)

    def cut(self) -> DataFrame:
        return self.table("cut", _CUT)

    def references(self) -> DataFrame:
        return self.sql(REFERENCES).withColumnRenamed("col", "column")

    def scopes(self) -> DataFrame:
        children = F.when(F.col("scope_id") == "scope_0", F.array(F.lit("scope_1"), F.lit("scope_3"))).when(F.col("scope_id") == "scope_1", F.array(F.lit("scope_2"))).otherwise(F.array().cast("array<string>"))
        return self.sql(SCOPES).withColumn("children", children).withColumn("start_col", F.lit(0)).withColumn("end_col", F.lit(1))

    def fine_bindings(self) -> DataFrame:
        return self.sql(FINE_BINDINGS).withColumnRenamed("col", "column")

    def fine_scopes(self) -> DataFrame:
        if "fine_scopes" not in self.kept:
            rows = self.sql(FINE_SCOPES)
            inner = rows.groupBy("path", F.col("parent_id").alias("scope_id")).agg(F.array_sort(F.collect_list("scope_id")).alias("children"))
            rows = rows.join(inner.where("scope_id is not null"), ["path", "scope_id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
            self.kept["fine_scopes"] = materialize(rows, "fine_scopes")
        return self.kept["fine_scopes"]

    def tree(self) -> DataFrame:
        return self.sql(TREE)

    def renames(self) -> DataFrame:
        return self.sql(RENAMES).withColumnRenamed("rename_key", "key")

    def sources(self) -> DataFrame:
        """Whole files of the derived lines."""
        rows = F.array_sort(F.collect_list(F.struct("line", "text")))
        return self.lines().groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("source"))

    def documents_as_sources(self) -> DataFrame:
        return self.given("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("source"))
