"""The registered queries of the validation operators, with their oracles in SQL.

The test tables are clean, so some queries derive nulls, blanks and bad texts
from keys by arithmetic; the oracle derives the same.
"""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.suggest import nearest
from ..operators.checks import duplicate_groups, field_violations, unique_violations
from ..operators.constraints import Format, Length, Pattern, Range, Required, Unique
from ..operators.dependency import Dependency, When, dependency_violations
from ..operators.integrity import Reference, Rules, Vocabulary, accepted, duplicate_keys, integrity_violations, judge, orphans
from ..operators.constraints import strictest
from ..operators.repeats import repeated_values
from ..sources import sinks
from ..sources.tables import dialect_of, read_csv, read_table, table_name, typed
from . import config, profiles, report, schema_import, validate
from .lineage import folder, staged
from .relations import ForeignKey, Shape, infer, targets_first
from .resolution import Mapping, active_variant, resolve_fields
from .transform import after_import, drop_null_columns, project

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return keep


# Ranges


def _range(name: str, table: str, key: str, column: str, rule: Range, where: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = field_violations(_table(spark, sf_dir, table), {column: (column, [rule])}, limit=None, row=key)
        return found.select(F.col("row_number").alias("key"), "tag", "severity", "field_name", F.col("value").cast("double").alias("value"), "error_message")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT CAST({key} AS BIGINT) AS key, 'RangeViolation' AS tag, 'error' AS severity, '{column}' AS field_name, CAST({column} AS DOUBLE) AS value, 'Value out of range' AS error_message FROM {table} WHERE {where}"


_range("range_inclusive", "lineitem", "l_orderkey", "l_quantity", Range(5, 45), "l_quantity < 5 OR l_quantity > 45")
_range("range_exclusive", "lineitem", "l_orderkey", "l_discount", Range(0, 0.1, inclusive=False), "l_discount <= 0 OR l_discount >= 0.1")
_range("range_min_only", "customer", "c_custkey", "c_acctbal", Range(min=0), "c_acctbal < 0")
_range("range_max_only", "orders", "o_orderkey", "o_totalprice", Range(max=400000), "o_totalprice > 400000")


# Formats

_DATE_TEXT = "concat(o_orderkey % 3000, '-', o_orderkey % 14, '-', o_orderkey % 33, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'T10:11:12Z' WHEN 2 THEN 'T25:00:00' ELSE '' END)"
_NUMBER_TEXT = "CASE o_orderkey % 6 WHEN 0 THEN 'k' || o_orderkey WHEN 1 THEN o_orderkey || '.5' WHEN 2 THEN '1_0' WHEN 3 THEN '1e' || (o_orderkey % 14) WHEN 4 THEN ' ' || o_orderkey ELSE '' END"
_URL_TEXT = "CASE WHEN page_id % 3 = 0 THEN 'ftp:' || url WHEN page_id % 3 = 1 THEN url ELSE url || ' x' END"
_MAIL_TEXT = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, '#', '@') || '.org' WHEN 2 THEN 'a@b' ELSE NULL END"
_UUID_TEXT = "CASE WHEN c_custkey % 2 = 0 THEN '123e4567-e89b-12d3-a456-4266141' || lpad(CAST(c_custkey AS STRING), 5, '0') ELSE c_name END"


def _format(name: str, table: str, key: str, text: str, rule: Format, bad: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, table).selectExpr(key, f"{text} AS txt")
        return field_violations(df, {"txt": ("txt", [rule])}, limit=None, row=key).select(F.col("row_number").alias("key"), "tag", "value")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT CAST({key} AS BIGINT) AS key, 'FormatViolation' AS tag, txt AS value FROM (SELECT {key}, {text.replace('AS STRING', 'AS VARCHAR')} AS txt FROM {table}) WHERE txt IS NOT NULL AND trim(txt) <> '' AND ({bad})"


_format("format_iso8601", "orders", "o_orderkey", _DATE_TEXT, Format("iso8601"), "try_strptime(txt, '%Y-%m-%d') IS NULL AND try_strptime(txt, '%Y-%m-%dT%H:%M:%S') IS NULL AND try_strptime(txt, '%Y-%m-%dT%H:%M:%SZ') IS NULL AND try_strptime(txt, '%Y-%m') IS NULL AND try_strptime(txt, '%Y') IS NULL")
_format("format_url", "pages", "page_id", _URL_TEXT, Format("url"), r"NOT regexp_matches(txt, '^https?://[^\s]+$')")
_format("format_email", "customer", "c_custkey", _MAIL_TEXT, Format("email"), r"NOT regexp_matches(txt, '^[^@\s]+@[^@\s]+\.[^@\s]+$')")
_format("format_uuid", "customer", "c_custkey", _UUID_TEXT, Format("uuid"), "NOT regexp_matches(txt, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')")
_format("format_integer", "orders", "o_orderkey", _NUMBER_TEXT, Format("integer"), "TRY_CAST(txt AS INTEGER) IS NULL")
_format("format_decimal", "orders", "o_orderkey", _NUMBER_TEXT, Format("decimal-degrees"), "TRY_CAST(txt AS DOUBLE) IS NULL")


# Patterns, lengths, presence


@_add("pattern", "SELECT CAST(p_partkey AS BIGINT) AS key, p_brand AS value, 'PatternViolation' AS tag FROM part WHERE NOT regexp_matches(p_brand, '^Brand#1')")
def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_violations(_table(spark, sf_dir, "part"), {"p_brand": ("p_brand", [Pattern("^Brand#1")])}, limit=None, row="p_partkey").select(F.col("row_number").alias("key"), "value", "tag")


@_add("pattern_unusable", "SELECT CAST(0 AS BIGINT) AS row_number, 'PatternViolation' AS tag, '' AS value UNION ALL SELECT p_partkey, 'PatternViolation', p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[1-3]')")
def _pattern_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One violation for the pattern that the matcher can't run, beside those of another."""
    rules = [Pattern("(?<=x)y"), Pattern("^Brand#[1-3]")]
    return field_violations(_table(spark, sf_dir, "part"), {"p_brand": ("p_brand", rules)}, limit=None, row="p_partkey").select("row_number", "tag", "value")


@_add("length", "SELECT CAST(p_partkey AS BIGINT) AS key, CAST(length(p_name) AS VARCHAR) AS actual FROM part WHERE length(p_name) < 9 OR length(p_name) > 9")
def _length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_violations(_table(spark, sf_dir, "part"), {"p_name": ("p_name", [Length(9, 9)])}, limit=None, row="p_partkey").select(F.col("row_number").alias("key"), F.col("params")["actualLength"].alias("actual"))


@_add("length_text", "SELECT doc_id AS key FROM documents WHERE length(text) > 3000")
def _length_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_violations(_table(spark, sf_dir, "documents"), {"text": ("text", [Length(max_length=3000)])}, limit=None, row="doc_id").select(F.col("row_number").alias("key"))


_GAPS = "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE o_orderpriority END"


def _required(name: str, rule: Required, bad: str, severity: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_GAPS} AS gap")
        return field_violations(df, {"gap": ("gap", [rule])}, limit=None, row="o_orderkey").select(F.col("row_number").alias("key"), "severity", "value", "error_message")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT o_orderkey AS key, '{severity}' AS severity, coalesce(gap, '') AS value, 'Required field \"gap\" is empty or null' AS error_message FROM (SELECT o_orderkey, {_GAPS} AS gap FROM orders) WHERE {bad}"


_required("required_strict", Required("required"), "gap IS NULL OR trim(gap) = ''", "error")
_required("required_allow_empty", Required("recommended", allow_empty=True), "gap IS NULL OR (length(gap) > 0 AND trim(gap) = '')", "warning")
_required("required_allow_blank", Required("optional", allow_empty=True, allow_whitespace=True), "gap IS NULL", "info")


@_add("required_strictest", f"SELECT o_orderkey AS key, 'error' AS severity FROM (SELECT o_orderkey, {_GAPS} AS gap FROM orders) WHERE gap IS NULL OR trim(gap) = ''")
def _strictest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_GAPS} AS gap")
    return field_violations(df, {"gap": ("gap", [Required("recommended"), Required("required"), Required("optional")])}, limit=None, row="o_orderkey").select(F.col("row_number").alias("key"), "severity")


@_add("capped", "SELECT l_orderkey AS row_number, count(*) AS n FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS n FROM lineitem WHERE l_quantity > 30) WHERE n <= 100 GROUP BY ALL")
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_violations(_table(spark, sf_dir, "lineitem"), {"l_quantity": ("l_quantity", [Range(max=30)])}, limit=100, row="l_orderkey").groupBy("row_number").agg(F.count("tag").alias("n"))


# Uniqueness and keys


@_add("unique_explode", "SELECT doc_id AS key, 'UniquenessViolation' AS tag FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def _unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_violations(_table(spark, sf_dir, "documents"), "text", limit=None, row="doc_id").select(F.col("row_number").alias("key"), "tag")


@_add("unique_topk", "SELECT t.value, t.count, e.event_id AS row_number FROM events e JOIN (SELECT user_id, CAST(user_id AS VARCHAR) AS value, count(*) AS count FROM events GROUP BY user_id HAVING count(*) > 1 ORDER BY count(*) DESC, CAST(user_id AS VARCHAR) LIMIT 10) t ON t.user_id = e.user_id")
def _unique_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_groups(_table(spark, sf_dir, "events"), "user_id", limit=10, row="event_id")


@_add(
    "unique_fields",
    """
WITH v AS (SELECT o_orderkey AS row_number, 'o_custkey' AS field_name, CAST(o_custkey AS VARCHAR) AS value FROM orders UNION ALL SELECT o_orderkey, 'o_orderkey', CAST(o_orderkey AS VARCHAR) FROM orders
  UNION ALL SELECT o_orderkey, 'clerk', CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey // 8 AS VARCHAR) END FROM orders),
top AS (SELECT field_name, value FROM v WHERE value IS NOT NULL GROUP BY field_name, value HAVING count(*) > 1 QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY count(*) DESC, value) <= 500)
SELECT 'UniquenessViolation' AS tag, v.field_name, v.value, v.row_number, 'Duplicate value: "' || v.value || '"' AS error_message FROM v JOIN top USING (field_name, value)
""",
)
def _unique_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three unique fields behind one sketch, the 500 most repeated values of each."""
    orders = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", "CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey div 8 AS STRING) END AS clerk")
    found = repeated_values(orders, [(c, c, Unique()) for c in ("o_orderkey", "o_custkey", "clerk")], 500, "o_orderkey")
    return found.select("tag", "field_name", "value", "row_number", "error_message")


@_add("primary_key_dups", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS duplicate_count FROM lineitem QUALIFY duplicate_count > 1")
def _primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber").alias("key"))
    return duplicate_keys(df, "key").select("l_orderkey", "l_linenumber", "l_partkey", "duplicate_count")


# Vocabularies


@_add("enum_violation", "SELECT event_id AS key, event_type AS value FROM events WHERE event_type NOT IN ('click', 'view', 'signup')")
def _enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules("events", vocabularies=(Vocabulary("event_type", "event_type", ("click", "view", "signup")),))
    return integrity_violations(judge(_table(spark, sf_dir, "events"), rules, "event_id"), rules, "event_id").select(F.col("row_number").alias("key"), "value")


_NEAR = ("BUILDNG", "MACHINERY", "FURNITUR", "AUTOMOBIL", "HOUSEHOL")


@_add("enum_suggest", f"SELECT c_custkey AS key, (SELECT arg_min(v, d * 100 + k) FROM (SELECT v, k, levenshtein(c_mktsegment, v) AS d FROM (VALUES {', '.join(f'({chr(39)}{v}{chr(39)}, {k})' for k, v in enumerate(_NEAR))}) w(v, k)) WHERE d < 3) AS suggested FROM customer WHERE c_mktsegment NOT IN ({', '.join(f'{chr(39)}{v}{chr(39)}' for v in _NEAR)})")
def _enum_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = Rules("customer", vocabularies=(Vocabulary("c_mktsegment", "c_mktsegment", _NEAR),))
    found = integrity_violations(judge(_table(spark, sf_dir, "customer"), rules, "c_custkey"), rules, "c_custkey")
    return found.select(F.col("row_number").alias("key"), F.col("params")["suggestedValue"].alias("suggested"))


@_add("levenshtein_nearest", "SELECT n_nationkey, n_name, (SELECT arg_min(v, d * 100 + k) FROM (SELECT v, k, levenshtein(n_name, v) AS d FROM (VALUES ('FRANCES', 0), ('NATION_2', 1), ('KENIA', 2)) w(v, k)) WHERE d < 3) AS suggested FROM nation")
def _nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation").select("n_nationkey", "n_name", nearest(F.col("n_name"), ["FRANCES", "NATION_2", "KENIA"]).alias("suggested"))


_TYPO = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN replace(c_name, 'tom', 'ot') WHEN 2 THEN concat(left(c_name, 9), 'x', substring(c_name, 10)) ELSE concat('no such ', c_name) END"


@_add(
    "enum_large_vocabulary",
    f"""
WITH bad AS (SELECT c_custkey AS key, {_TYPO} AS value FROM customer),
words AS (SELECT c_name AS word, c_custkey AS ordinal FROM customer),
near AS (SELECT b.value, arg_min(w.word, levenshtein(b.value, w.word) * 1000000 + w.ordinal) AS suggested FROM (SELECT DISTINCT value FROM bad) b JOIN words w ON abs(length(b.value) - length(w.word)) < 3 AND levenshtein(b.value, w.word) < 3 GROUP BY b.value)
SELECT b.key, b.value, n.suggested, 'Invalid value "' || b.value || '".' || coalesce(' Did you mean "' || n.suggested || '"?', '') AS error_message
FROM bad b LEFT JOIN near n ON n.value = b.value WHERE b.value NOT IN (SELECT word FROM words)
""",
)
def _large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' names as a vocabulary, a table, and misspelt ones as values."""
    customer = _table(spark, sf_dir, "customer")
    words = customer.select(F.col("c_name").alias("word"), F.col("c_custkey").alias("ordinal"))
    rules = Rules("customer", vocabularies=(Vocabulary("name", "name", (), table=words),))
    judged = judge(customer.select("c_custkey", F.expr(_TYPO).alias("name")), rules, "c_custkey")
    return integrity_violations(judged, rules, "c_custkey").select(F.col("row_number").alias("key"), "value", F.col("params")["suggestedValue"].alias("suggested"), "error_message")


@_add("pattern_of_groups", "SELECT CAST(p_partkey AS BIGINT) AS key, p_type AS value FROM part WHERE NOT regexp_matches(p_type, '^(([A-Z]+|%) ?)*$') OR NOT regexp_matches(p_type, '(E|S)(T|E)+')")
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that repeat groups, matched by an automaton."""
    rules = [Pattern("^(([A-Z]+|%) ?)*$"), Pattern("(E|S)(T|E)+")]
    return field_violations(_table(spark, sf_dir, "part"), {"p_type": ("p_type", rules)}, limit=None, row="p_partkey").select(F.col("row_number").alias("key"), "value").distinct()


# References


@_add("fk_orphan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def _orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "customer").filter("c_acctbal >= 0")
    return orphans(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", good, "c_custkey")


@_add("fk_cascade", "WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)) SELECT l_orderkey AS value, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o) GROUP BY l_orderkey")
def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = Rules("customer", ("c_custkey", "c_custkey"), vocabularies=(Vocabulary("c_mktsegment", "c_mktsegment", ("BUILDING", "MACHINERY")),))
    good = accepted(judge(_table(spark, sf_dir, "customer"), customers, "c_custkey"), [("c_custkey", "c_custkey")])
    orders = Rules("orders", ("o_orderkey", "o_orderkey"), references=(Reference("o_custkey", "o_custkey", "customer", "c_custkey"),), parents={"customer": good})
    good = accepted(judge(_table(spark, sf_dir, "orders"), orders, "o_orderkey"), [("o_orderkey", "o_orderkey")])
    lines = Rules("lineitem", references=(Reference("l_orderkey", "l_orderkey", "orders", "o_orderkey"),), parents={"orders": good})
    found = integrity_violations(judge(_table(spark, sf_dir, "lineitem"), lines, "l_orderkey"), lines, "l_orderkey")
    return found.groupBy(F.col("row_number").alias("value")).agg(F.count("tag").alias("n"))


_PARENT = "CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN c_custkey + 1 ELSE CAST(floor(c_custkey / 3) AS BIGINT) END"


@_add("fk_self", f"WITH RECURSIVE t AS (SELECT c_custkey, {_PARENT} AS parent FROM customer), good AS (SELECT c_custkey FROM t WHERE parent IS NULL UNION ALL SELECT t.c_custkey FROM t JOIN good g ON t.parent = g.c_custkey AND g.c_custkey < t.c_custkey) SELECT c_custkey AS key, CAST(parent AS VARCHAR) AS value FROM t WHERE c_custkey NOT IN (SELECT c_custkey FROM good)")
def _self(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PARENT} AS parent")
    rules = Rules("customer", ("c_custkey", "c_custkey"), references=(Reference("parent", "parent", "customer", "c_custkey"),))
    return integrity_violations(judge(df, rules, "c_custkey"), rules, "c_custkey").filter("tag = 'ForeignKeyViolation'").select(F.col("row_number").alias("key"), "value")


_TREE = "SELECT o_orderkey AS rn, o_custkey AS id, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN -1 ELSE CAST(floor(o_custkey / 2) AS BIGINT) END AS up, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders"


@_add(
    "accepted_hierarchy",
    f"""
WITH RECURSIVE raw AS ({_TREE}),
good AS (SELECT rn, id FROM raw WHERE up IS NULL AND st <> 'X' UNION SELECT r.rn, r.id FROM raw r JOIN good g ON r.up = g.id AND g.rn < r.rn WHERE r.st <> 'X'),
held AS (SELECT id, min(rn) AS first FROM good GROUP BY id)
SELECT r.rn, CASE WHEN r.st = 'X' THEN 'enum' WHEN r.rn > own.first THEN 'pk' WHEN r.up IS NOT NULL AND NOT coalesce(above.first < r.rn, FALSE) THEN 'fk' ELSE 'ok' END AS kind
FROM raw r LEFT JOIN held own ON own.id = r.id LEFT JOIN held above ON above.id = r.up
""",
)
def _hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_TREE.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))
    rules = Rules("orders", ("id", "id"), vocabularies=(Vocabulary("st", "st", ("O", "F", "P")),), references=(Reference("up", "up", "orders", "id"),))
    return judge(raw, rules, "rn").select("rn", "kind")


# Dependencies

_FACTS = "SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(user_id AS {text}) END AS who, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE CAST(value AS {text}) END AS amount FROM events"
_FACTS_SQL = _FACTS.format(text="VARCHAR")


def _dependency(name: str, rule: Dependency, bad: str, severity: str, message: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        _table(spark, sf_dir, "events")
        facts = spark.sql(_FACTS.format(text="STRING").replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))
        return dependency_violations(facts, rule, limit=None, row="event_id").select(F.col("row_number").alias("key"), "severity", "error_message")

    QUERIES[name] = query
    ORACLES[name] = f"SELECT event_id AS key, '{severity}' AS severity, '{message}' AS error_message FROM ({_FACTS_SQL}) WHERE {bad}"


_NO_WHO, _NO_AMOUNT = "(who IS NULL OR trim(who) = '')", "(amount IS NULL OR trim(amount) = '')"
_dependency("dependency_oneof", Dependency(("who", "amount"), one_of=True), f"{_NO_WHO} AND {_NO_AMOUNT}", "error", "At least one of [who, amount] must be present")
_dependency("dependency_allof", Dependency(("who", "amount"), level="recommended"), f"{_NO_WHO} OR {_NO_AMOUNT}", "warning", "Fields [who, amount] are required")
_dependency("dependency_when_equals", Dependency(("amount",), when=When("event_type", equals="purchase")), f"event_type = 'purchase' AND {_NO_AMOUNT}", "error", "[amount] required when event_type equals ''purchase''")
_dependency("dependency_when_in", Dependency(("who",), when=When("event_type", among=("click", "view"))), f"event_type IN ('click', 'view') AND {_NO_WHO}", "error", "[who] required when event_type is one of [click, view]")
_dependency("dependency_when_present", Dependency(("who",), when=When("amount")), f"NOT {_NO_AMOUNT} AND {_NO_WHO}", "error", "[who] required when amount is present")


@_add(
    "fields_and_rules",
    f"""
WITH f AS ({_FACTS_SQL})
SELECT event_id AS key, 'RequiredFieldViolation' AS tag, 'warning' AS severity, 'who' AS field_name, coalesce(who, '') AS value, 'Required field "who" is empty or null' AS error_message FROM f WHERE {_NO_WHO}
UNION ALL SELECT event_id, 'DependencyViolation', 'error', 'who, amount', '', 'At least one of [who, amount] must be present' FROM f WHERE {_NO_WHO} AND {_NO_AMOUNT}
UNION ALL SELECT event_id, 'DependencyViolation', 'info', 'amount', '', '[amount] required when event_type equals ''click''' FROM f WHERE event_type = 'click' AND {_NO_AMOUNT}
""",
)
def _fields_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = spark.sql(_FACTS.format(text="STRING").replace("FROM events", "FROM {events}"), events=_table(spark, sf_dir, "events"))
    rules = [Dependency(("who", "amount"), one_of=True), Dependency(("amount",), when=When("event_type", equals="click"), level="optional")]
    found = field_violations(facts, {"who": ("who", [Required("recommended")])}, limit=None, row="event_id", rules=[r.check() for r in rules])
    return found.select(F.col("row_number").alias("key"), "tag", "severity", "field_name", "value", "error_message")


# Several checks at once

_MIXED = "SELECT o_orderkey AS rn, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 5000 END AS id, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderpriority END AS need, CASE WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_custkey END AS fk FROM orders"


@_add(
    "integrity_first_error",
    f"""
WITH raw AS ({_MIXED}),
r AS (SELECT *, st NOT IN ('O', 'F', 'P') AS enum_bad, need IS NULL AS null_bad, id IS NULL AS pk_null, fk IS NOT NULL AND fk NOT IN (SELECT c_custkey FROM customer) AS fk_bad FROM raw),
c AS (SELECT *, NOT (enum_bad OR null_bad OR pk_null OR fk_bad) AS cand FROM r),
w AS (SELECT *, min(CASE WHEN cand THEN rn END) OVER (PARTITION BY id) AS winner FROM c)
SELECT rn, CASE WHEN enum_bad THEN 'enum' WHEN id IS NOT NULL AND rn > winner THEN 'pk' WHEN null_bad THEN 'null' WHEN fk_bad THEN 'fk' WHEN pk_null THEN 'key_null' ELSE 'ok' END AS kind FROM w
""",
)
def _first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.sql(_MIXED.replace("FROM orders", "FROM {orders}"), orders=_table(spark, sf_dir, "orders"))
    rules = Rules("orders", ("id", "id"), not_null=(("need", "need"),), vocabularies=(Vocabulary("st", "st", ("O", "F", "P")),), references=(Reference("fk", "fk", "customer", "c_custkey"),), parents={"customer": _table(spark, sf_dir, "customer")})
    return judge(raw, rules, "rn").select("rn", "kind")


_FUSED = {
    "l_quantity": ("quantity", [Range(2, 49), Required()]),
    "l_discount": ("discount", [Range(max=0.09), Format("decimal-degrees")]),
    "l_returnflag": ("flag", [Pattern("^[AN]$"), Length(1, 1)]),
    "l_tax": ("tax", [Range(0.01, 0.07)]),
}
_FUSED_SQL = """
SELECT l_orderkey AS key, 'RangeViolation' AS tag, 'quantity' AS target_name, 'error' AS severity FROM lineitem WHERE l_quantity < 2 OR l_quantity > 49
UNION ALL SELECT l_orderkey, 'RangeViolation', 'discount', 'error' FROM lineitem WHERE l_discount > 0.09
UNION ALL SELECT l_orderkey, 'PatternViolation', 'flag', 'error' FROM lineitem WHERE NOT regexp_matches(l_returnflag, '^[AN]$')
UNION ALL SELECT l_orderkey, 'RangeViolation', 'tax', 'error' FROM lineitem WHERE l_tax < 0.01 OR l_tax > 0.07
"""


@_add("fused_validation", _FUSED_SQL)
def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_violations(_table(spark, sf_dir, "lineitem"), _FUSED, limit=None, row="l_orderkey").select(F.col("row_number").alias("key"), "tag", "target_name", "severity")


@_add("severity_summary", f"SELECT severity, count(*) AS n, count(DISTINCT target_name) AS fields FROM ({_FUSED_SQL}) GROUP BY severity")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).groupBy("severity").agg(F.count("tag").alias("n"), F.countDistinct("target_name").alias("fields"))


@_add("violations_by_field", f"SELECT target_name, tag, count(*) AS n FROM ({_FUSED_SQL}) GROUP BY ALL")
def _by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).groupBy("target_name", "tag").agg(F.count("severity").alias("n"))


@_add("dataset_status", f"SELECT 'lineitem' AS dataset, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'fail' WHEN count(*) FILTER (severity = 'warning') > 0 THEN 'warn' ELSE 'pass' END AS status, (SELECT count(*) FROM lineitem) AS rows FROM ({_FUSED_SQL})")
def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _fused(spark, sf_dir).agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    rows = _table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("rows"))
    return found.join(rows).select(F.lit("lineitem").alias("dataset"), F.when(F.col("e") > 0, "fail").when(F.col("w") > 0, "warn").otherwise("pass").alias("status"), "rows")


# Transforms


@_add("row_count", "SELECT count(*) AS rows FROM lineitem")
def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("rows"))


@_add("rename_projection", "SELECT c_custkey AS customerID, c_name AS label FROM customer")
def _rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customerID"), F.col("c_name").alias("label"))


@_add("dependency_limited", "SELECT 'DependencyViolation' AS tag, 'error' AS severity, o_orderkey AS row_number, 'Fields [priority] are required' AS error_message FROM orders WHERE o_orderkey % 7 = 0 ORDER BY o_orderkey LIMIT 20")
def _dependency_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority")
    return dependency_violations(rows, Dependency(("priority",)), limit=20, row="o_orderkey").select("tag", "severity", F.col("row_number").cast("bigint").alias("row_number"), "error_message")


def _dialect(name: str, delimiter: str, label: str, sql: str) -> None:
    """Customers written with a delimiter of their own, and read with what is found in the file."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = folder(spark, name)
        own = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(label).alias("label"))
        own.write.csv(path, sep=delimiter, header=True, quote='"', escape='"')
        return read_csv(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "label")

    QUERIES[name], ORACLES[name] = query, f"SELECT CAST(c_custkey AS BIGINT) AS c_custkey, {sql} AS label FROM customer"


_dialect("csv_semicolon", ";", "concat(c_name, '; ', c_mktsegment)", "concat(c_name, '; ', c_mktsegment)")
_dialect("csv_tab", "\t", "concat(c_name, ', ', c_mktsegment)", "concat(c_name, ', ', c_mktsegment)")
_dialect("csv_multiline", ",", "concat(c_name, '\\n', c_mktsegment, ' \"x\"')", "concat(c_name, chr(10), c_mktsegment, ' \"x\"')")


@_add("csv_headerless", "SELECT 'column0' AS key_name, 'column2' AS balance_name, c_custkey, c_name, c_acctbal FROM customer")
def _headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written without a header, with ' as the quote: both are found, and places are the names."""
    path = folder(spark, "headerless")
    _table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("; x")).alias("c_name"), "c_acctbal").write.csv(path, sep=";", quote="'", escape="'", quoteAll=True, header=False)
    own = typed(read_csv(spark, path))
    return own.select(F.lit(own.columns[0]).alias("key_name"), F.lit(own.columns[2]).alias("balance_name"), F.col(own.columns[0]).alias("c_custkey"), F.expr("split_part(column1, '; x', 1)").alias("c_name"), F.col(own.columns[2]).alias("c_acctbal"))


_ODD_ROWS = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat(c_custkey, ',\"', c_name, '\",', c_nationkey, ',EXTRA') WHEN 1 THEN concat(c_custkey, ',', c_name) ELSE concat(c_custkey, ',', c_name, ',', c_nationkey) END AS value FROM customer"


@_add("csv_rejects", f"SELECT 'RowShapeViolation' AS tag, 'error' AS severity, value, 'Row does not fit the file''s 3 columns' AS error_message FROM ({_ODD_ROWS}) WHERE c_custkey % 5 < 2")
def _csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with surplus and lacking values become violations."""
    path = folder(spark, "rejects")
    spark.sql(_ODD_ROWS.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer")).select("value").write.text(path)
    rows = staged(read_csv(spark, path, rejected=validate.REJECTED, dialect=dialect_of(spark, path, header=False)), "rejects")
    return validate.rejected_rows(rows, 3).select("tag", "severity", "value", "error_message")


@_add("csv_multiline_split", "SELECT doc_id, length(text) AS chars, md5(text) AS text_md5 FROM documents")
def _multiline_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, whose line ends are quoted, cut by as many tasks as the files have blocks."""
    path = folder(spark, "split")
    _table(spark, sf_dir, "documents").select("doc_id", "text").write.csv(path, header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    own = read_csv(spark, path, (), multiline=True)
    return own.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("text_md5"))


@_add("drop_null_columns", "SELECT c_custkey, c_name FROM customer")
def _drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_null_columns(_table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "CAST(NULL AS STRING) AS remarks", "nullif(c_acctbal, c_acctbal) AS gone"))


def _transform(name: str, sources: dict[str, str], fields: dict[str, str | float | None], oracle: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        tables = {t: _table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem", "events", "part", "supplier")}
        return project(spark, tables, sources, fields)

    QUERIES[name], ORACLES[name] = query, oracle


_transform("transform_envelope", {"e": "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mid FROM orders)"}, {"lo": "e.lo", "hi": "e.hi", "mid": "round(e.mid, 2)", "kind": "'envelope'"}, "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 2) AS mid, 'envelope' AS kind FROM orders")
_transform(
    "transform_rollup",
    {"t": "(SELECT o_custkey, o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi, string_agg(CAST(o_orderkey AS STRING)) AS ids FROM orders GROUP BY o_custkey, o_orderstatus)"},
    {"who": "concat_ws('-', o_custkey, o_orderstatus)", "lo": "lo", "hi": "hi", "idLength": "length(ids)"},
    "SELECT concat_ws('-', o_custkey, o_orderstatus) AS who, min(o_totalprice) AS lo, max(o_totalprice) AS hi, length(string_agg(CAST(o_orderkey AS VARCHAR), ',')) AS idLength FROM orders GROUP BY o_custkey, o_orderstatus",
)
_transform("transform_inner_join", {"t": "(SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"}, {"number": "o_orderkey", "who": "c_name"}, "SELECT o_orderkey AS number, c_name AS who FROM orders JOIN customer ON o_custkey = c_custkey")
_transform("transform_largest", {"t": "(SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)"}, {"number": "o_orderkey", "price": "o_totalprice"}, "SELECT o_orderkey AS number, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
_transform("transform_quoted_names", {"t": '(SELECT c_custkey AS "order", c_name FROM customer)'}, {"number": '"order"', "who": "c_name"}, "SELECT c_custkey AS number, c_name AS who FROM customer")
_transform("transform_today", {"n": "nation"}, {"place": "n_name", "now": "today() = current_date()"}, "SELECT n_name AS place, today() = current_date AS now FROM nation")
_transform("transform_distinct", {"t": "(SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)"}, {"segment": "c_mktsegment", "nation": "c_nationkey"}, "SELECT DISTINCT c_mktsegment AS segment, c_nationkey AS nation FROM customer")
_transform("transform_left_join", {"t": "(SELECT n.n_name, r.r_name, s.s_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name LIKE 'A%' LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey)"}, {"place": "n_name", "part": "r_name", "supplier": "s_name"}, "SELECT n.n_name AS place, r.r_name AS part, s.s_name AS supplier FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey AND r.r_name LIKE 'A%' LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey")
_transform("transform_case_alias", {"p": "part"}, {"kind": "CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END", "unit": "CASE WHEN kind = 'steel' THEN 'kg' ELSE 'piece' END", "id": "p_partkey"}, "SELECT CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' ELSE 'other' END AS kind, CASE WHEN p_type LIKE '%STEEL%' THEN 'kg' ELSE 'piece' END AS unit, p_partkey AS id FROM part")
_transform("transform_cross_sources", {"n": "nation", "e": "(SELECT min(c_acctbal) AS lo FROM customer)"}, {"name": "n.n_name", "lo": "e.lo"}, "SELECT n.n_name AS name, e.lo FROM nation n, (SELECT min(c_acctbal) AS lo FROM customer) e")
_transform("transform_concat_ids", {"o": "orders"}, {"id": "'ord' || o_orderkey || ':' || strftime(o_orderdate, '%Y%m%d')", "day": "strftime(o_orderdate, '%d')"}, "SELECT 'ord' || o_orderkey || ':' || strftime(o_orderdate, '%Y%m%d') AS id, strftime(o_orderdate, '%d') AS day FROM orders")
_transform("transform_split_part", {"o": "(SELECT * FROM orders WHERE split_part(o_orderpriority, '-', 2) IS NOT NULL)"}, {"key": "o_orderkey", "level": "split_part(o_orderpriority, '-', 1)", "rest": "TRIM(REPLACE(split_part(o_orderpriority, '-', 2), 'E', 'e'))", "short": "o_orderpriority[0:2]"}, "SELECT o_orderkey AS key, split_part(o_orderpriority, '-', 1) AS level, trim(replace(split_part(o_orderpriority, '-', 2), 'E', 'e')) AS rest, substring(o_orderpriority, 1, 2) AS short FROM orders")
_transform("transform_rownum", {"c": "(SELECT *, c_custkey AS _row_number FROM customer WHERE c_acctbal > 0)"}, {"id": "concat('c', row_number() OVER ())", "key": "c_custkey", "score": 5, "nothing": "CAST(NULL AS STRING)"}, "SELECT 'c' || row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS key, 5 AS score, CAST(NULL AS VARCHAR) AS nothing FROM customer WHERE c_acctbal > 0")


@_add("transform_union_by_name", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS label, CAST(NULL AS VARCHAR) AS size FROM customer UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, CAST(p_size AS VARCHAR) FROM part")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: _table(spark, sf_dir, t) for t in ("customer", "part")}
    one = project(spark, tables, {"c": "customer"}, {"id": "CAST(c_custkey AS STRING)", "label": "c_name"})
    two = project(spark, tables, {"p": "part"}, {"id": "CAST(p_partkey AS STRING)", "size": "CAST(p_size AS STRING)"})
    return one.unionByName(two, allowMissingColumns=True)


@_add("after_import_statements", "SELECT c_custkey, upper(c_name) AS c_name, CASE WHEN c_acctbal < 0 THEN 'owes, ' || c_mktsegment END AS note FROM customer")
def _after_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": _table(spark, sf_dir, "customer")}
    statements = ["ALTER TABLE customer ADD COLUMN note VARCHAR", "UPDATE customer SET note = concat('owes, ', c_mktsegment) WHERE c_acctbal < 0", "UPDATE customer SET c_name = upper(c_name)"]
    return after_import(spark, tables, statements)["customer"].select("c_custkey", "c_name", "note")


_transform("transform_slices", {"c": "customer"}, {"key": "c_custkey", "head": "upper(c_name)[0:2]", "tail": "c_name[-3:]", "middle": "concat(c_name, c_mktsegment)[c_custkey % 4 + 1:-2]"}, "SELECT c_custkey AS key, upper(c_name)[0:2] AS head, c_name[-3:] AS tail, concat(c_name, c_mktsegment)[c_custkey % 4 + 1:-2] AS middle FROM customer")
_transform("transform_dates", {"o": "orders"}, {"key": "o_orderkey", "day": "strftime(o_orderdate, '%-d/%-m/%Y')", "told": "strftime(o_orderdate, '%A, %-d %B at %I %p, it''s day %j T')"}, "SELECT o_orderkey AS key, strftime(o_orderdate, '%-d/%-m/%Y') AS day, strftime(o_orderdate, '%A, %-d %B at %I %p, it''s day %j T') AS told FROM orders")
_transform(
    "transform_rownum_sources",
    {"c": "(SELECT *, c_custkey AS _row_number FROM customer)", "e": "(SELECT max(c_acctbal) AS most FROM customer)", "n": "(SELECT a.n_nationkey, b.r_name, a.n_nationkey AS _row_number, row_number() OVER () AS place FROM (SELECT *, n_nationkey AS _row_number FROM nation) a JOIN region b ON a.n_regionkey = b.r_regionkey)"},
    {"id": "row_number() OVER ()", "pair": "c.c_custkey * 100 + n.n_nationkey", "place": "place", "most": "e.most"},
    "SELECT row_number() OVER (ORDER BY c_custkey, n_nationkey) AS id, c_custkey * 100 + n_nationkey AS pair, row_number() OVER (PARTITION BY c_custkey ORDER BY n_nationkey) AS place, (SELECT max(c_acctbal) FROM customer) AS most FROM customer, nation",
)


def _statements(name: str, oracle: str, *own: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return after_import(spark, {t: _table(spark, sf_dir, t) for t in ("customer", "orders", "nation")}, list(own))["customer"].select("c_custkey", "c_name", "c_acctbal")

    QUERIES[name], ORACLES[name] = query, oracle


_statements("after_import_delete", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING')", "DELETE FROM customer WHERE c_acctbal < 0; DELETE FROM customer WHERE c_mktsegment = 'BUILDING'")
_statements("after_import_insert", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT o_orderkey + 1000000, o_orderpriority, NULL FROM orders WHERE o_orderstatus = 'P' UNION ALL VALUES (-1, 'it''s one', 2.5)", "INSERT INTO customer (c_name, c_custkey) SELECT o_orderpriority, o_orderkey + 1000000 FROM orders WHERE o_orderstatus = 'P'", "INSERT INTO customer (c_custkey, c_name, c_acctbal) VALUES (-1, 'it''s one', 2.5)")
_statements("after_import_update_from", "SELECT c_custkey, coalesce(n_name, c_name) AS c_name, CASE WHEN n_name IS NULL THEN c_acctbal ELSE c_acctbal + n_nationkey END AS c_acctbal FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey < 3", "UPDATE customer SET c_name = n.n_name, c_acctbal = c_acctbal + n.n_nationkey FROM nation n WHERE n.n_nationkey = customer.c_nationkey AND n.n_regionkey < 3")


# Sources and sinks


@_add("row_numbers", "SELECT count(*) AS n, CAST(1 AS BIGINT) AS least, count(*) AS most, count(*) AS different, CAST(count(*) * (count(*) + 1) / 2 AS BIGINT) AS total FROM lineitem")
def _row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read_table(spark, f"{sf_dir}/lineitem.parquet").select("_row_number")
    return own.agg(F.count("_row_number").alias("n"), F.min("_row_number").alias("least"), F.max("_row_number").alias("most"), F.countDistinct("_row_number").alias("different"), F.sum("_row_number").alias("total"))


_MARKED = "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'a, \"b\"' WHEN 2 THEN '007' ELSE c_name END AS label, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE '2024-01-02' END AS day FROM customer"


def _csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.sql(_MARKED.replace("FROM customer", "FROM {customer}"), customer=_table(spark, sf_dir, "customer"))
    return read_csv(spark, sinks.write_csv(df, folder(spark, "csv"), single=False))


@_add("csv_round_trip", f"SELECT c_custkey, nullif(label, 'NA') AS label, c_acctbal, nullif(day, 'N/A') AS day FROM ({_MARKED})")
def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(_csv(spark, sf_dir)).drop("_row_number").withColumn("day", F.col("day").cast("string"))


@_add("csv_types", "SELECT * FROM (VALUES ('c_custkey', 'bigint'), ('label', 'string'), ('c_acctbal', 'double'), ('day', 'date'), ('_row_number', 'bigint')) t(name, type)")
def _csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(typed(_csv(spark, sf_dir)).dtypes, "name string, type string")


# Rules that are resolved on the driver


_PRESET_FAULTS = {"latitude": "abs(v) > 90", "longitude": "abs(v) > 180", "depth": "v < 0", "isoDate": "v < 0", "uniqueId": "repeated > 1", "requiredText": "v IS NULL", "url": "TRUE", "uuid": "TRUE", "countryCode": "TRUE", "year": "v < 1000 OR v > 2100", "month": "v < 1 OR v > 12", "day": "v < 1 OR v > 31"}
_PRESET_TYPES = {"latitude": "range,format", "longitude": "range,format", "depth": "range", "isoDate": "format", "uniqueId": "required,unique", "requiredText": "required", "url": "format", "uuid": "format", "countryCode": "pattern", "year": "range,format", "month": "range,format", "day": "range,format"}


@_add("presets", "WITH d AS (SELECT c_nationkey * 20 - 100 AS v, count(*) OVER (PARTITION BY c_nationkey) AS repeated FROM customer) " + " UNION ALL ".join(f"SELECT '{n}' AS name, '{_PRESET_TYPES[n]}' AS types, count(*) AS n FROM d WHERE {bad}" for n, bad in _PRESET_FAULTS.items()))
def _presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each preset's constraints, and how many violations they find in one column of the customers."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(c_nationkey * 20 - 100 AS INT) AS v")
    rows = rows.select("c_custkey", *[F.col("v").alias(n) for n in profiles.PRESETS])
    found = field_violations(rows, {n: (n, own) for n, own in profiles.PRESETS.items()}, limit=None, row="c_custkey")
    unique = [(n, n, c) for n, own in profiles.PRESETS.items() for c in own if isinstance(c, Unique)]
    counts = found.unionByName(repeated_values(rows, unique, None, "c_custkey")).groupBy("target_name").agg(F.count("tag").alias("found"))
    named = spark.createDataFrame([(n, ",".join(c.type for c in own)) for n, own in profiles.PRESETS.items()], "name string, types string")
    return named.join(counts, F.col("name") == F.col("target_name"), "left").select("name", "types", F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


_RESOLVED = "SELECT o_orderkey AS rn, o_orderkey AS eventID, CASE WHEN o_orderkey % 7 > 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS `when`, o_orderkey % 400 - 200 AS decimalLatitude, o_orderkey % 300 * 50 AS deep FROM {orders}"


@_add(
    "resolved_fields",
    """
SELECT 'eventDate' AS target, 'when' AS origin, 'required' AS level, 'format,required' AS types, count(*) AS n FROM orders WHERE o_orderkey % 7 = 0
UNION ALL SELECT 'decimalLatitude', 'decimalLatitude', 'required', 'range,required', count(*) FROM orders WHERE abs(o_orderkey % 400 - 200) > 90
UNION ALL SELECT 'maximumDepthInMeters', 'deep', 'required', 'range,required,range,required', 2 * count(*) FROM orders WHERE o_orderkey % 300 * 50 > 11000
UNION ALL SELECT 'eventID', 'eventID', 'required', 'unique,required', 0
""",
)
def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules resolved from the dictionary, a profile and mappings, and the violations that they find in the orders."""
    fields = resolve_fields(profiles.resolve("Event", "obis"), "obis", [Mapping("when", "eventDate", "optional"), Mapping("deep", "maximumDepthInMeters", "required", preset="depth")])
    own = {t: fields[t] for t in ("eventDate", "decimalLatitude", "maximumDepthInMeters", "eventID")}
    rows = spark.sql(_RESOLVED, orders=_table(spark, sf_dir, "orders"))
    counts = field_violations(rows, {f.origin: (t, f.constraints) for t, f in own.items()}, limit=None, row="rn").groupBy("target_name").agg(F.count("tag").alias("found"))
    named = spark.createDataFrame([(t, f.origin, strictest(f.constraints).level, ",".join(c.type for c in f.constraints)) for t, f in own.items()], "target string, origin string, level string, types string")
    return named.join(counts, F.col("target") == F.col("target_name"), "left").select("target", "origin", "level", "types", F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


_SHAPES = [Shape("facts", "ExtendedMeasurementOrFact", ("measurementID", "eventID", "occurrenceID")), Shape("finds", "Occurrence", ("occurrenceID", "eventID")), Shape("events", "Event", ("eventID", "parentEventID"))]


_DATASETS = {
    "events": "SELECT o_orderkey AS eventID, CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey - 1 END AS parentEventID FROM {orders}",
    "finds": "SELECT l_orderkey * 10 + l_linenumber AS occurrenceID, CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS eventID FROM {lineitem}",
    "facts": "SELECT event_id AS measurementID, event_id * 10 + 1 AS eventID, event_id * 10 + 2 AS occurrenceID FROM {events}",
}
_DATASETS_SQL = ", ".join(f"{n} AS ({q.replace('{', '').replace('}', '')})" for n, q in {f"d_{k}": v for k, v in _DATASETS.items()}.items())


def _datasets(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    tables = {t: _table(spark, sf_dir, t) for t in ("orders", "lineitem", "events")}
    return {n: spark.sql(q, **{t: df for t, df in tables.items() if f"{{{t}}}" in q}) for n, q in _DATASETS.items()}


@_add("relations_inferred", f"WITH {_DATASETS_SQL} " + " UNION ALL ".join(f"SELECT '{s}' AS source, '{f}' AS field, '{t}' AS target, '{tf}' AS target_field, count(*) AS orphans FROM d_{s} s WHERE s.{f} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d_{t} t WHERE t.{tf} = s.{f})" for s, f, t, tf in [("facts", "eventID", "finds", "occurrenceID"), ("facts", "occurrenceID", "finds", "occurrenceID"), ("finds", "eventID", "events", "eventID"), ("events", "parentEventID", "events", "eventID")]))
def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, declared and inferred, and the orphans of each."""
    declared, tables, out = ForeignKey("facts", "eventID", "finds", "occurrenceID"), _datasets(spark, sf_dir), None
    for k in [declared, *infer(_SHAPES, [declared])]:
        lost = orphans(tables[k.source_dataset], k.source_field, tables[k.target_dataset], k.target_field).agg(F.count(F.lit(1)).alias("orphans"))
        told = lost.select(F.lit(k.source_dataset).alias("source"), F.lit(k.source_field).alias("field"), F.lit(k.target_dataset).alias("target"), F.lit(k.target_field).alias("target_field"), "orphans")
        out = told if out is None else out.unionByName(told)
    return out


@_add("targets_first", "SELECT 1 AS place, 'events' AS name, count(*) AS rows FROM orders UNION ALL SELECT 2, 'finds', count(*) FROM lineitem UNION ALL SELECT 3, 'facts', count(*) FROM events")
def _targets_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets in the order in which they are judged, with their rows."""
    tables, out = _datasets(spark, sf_dir), None
    for place, name in enumerate(targets_first([s.name for s in _SHAPES], infer(_SHAPES)), 1):
        told = tables[name].agg(F.count(F.lit(1)).alias("rows")).select(F.lit(place).alias("place"), F.lit(name).alias("name"), "rows")
        out = told if out is None else out.unionByName(told)
    return out


# Sinks, names and imported dictionaries


@_add("csv_single_file", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_nationkey + 1 AS BIGINT) AS row_number FROM nation")
def _csv_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey")
    path = sinks.write_csv(own, folder(spark, "nation") + ".csv", single=True)
    return read_table(spark, path).select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), "n_name", F.col("_row_number").alias("row_number"))


@_add("database_sink", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def _database(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sinks.write_database({"supplier": _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")}, folder(spark, "database"))
    return spark.read.parquet(f"{made}/supplier")


@_add("names", "SELECT n_nationkey AS my_file_v2, n_name AS \"Event Date\", '2024-01-02T03-04-05-678Z' AS stamp FROM nation")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations under names that are made of file and field names."""
    moment = datetime(2024, 1, 2, 3, 4, 5, 678000, timezone.utc)
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(table_name("my-file.v2")), F.col("n_name").alias(schema_import.label("eventDate")), F.lit(sinks.stamp(moment)).alias("stamp"))


@_add("active_variants", "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 7 = 0) SELECT asked, variant, warned, severity, n FROM (VALUES ('obis', 'obis', FALSE, 'error'), ('gbif', 'gbif', FALSE, 'error'), ('other', 'obis', TRUE, 'error'), (NULL, 'obis', TRUE, 'error')) t(asked, variant, warned, severity), n")
def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a missing date of an order is, under each variant that a configuration may ask for."""
    rows, out = spark.sql(_RESOLVED, orders=_table(spark, sf_dir, "orders")), None
    for asked in ("obis", "gbif", "other", None):
        variant, warning = active_variant(asked)
        own = resolve_fields(profiles.resolve("Event", variant), variant, [])["eventDate"]
        found = field_violations(rows, {"when": ("eventDate", own.constraints)}, limit=None, row="rn").agg(F.max("severity").alias("severity"), F.count("tag").alias("n"))
        told = found.select(F.lit(asked).cast("string").alias("asked"), F.lit(variant).alias("variant"), F.lit(warning is not None).alias("warned"), "severity", "n")
        out = told if out is None else out.unionByName(told)
    return out


_XML = '<extension name="Event" rowType="r" xmlns:d="d"><property name="eventID"/><property name="eventType" d:thesaurus="kinds"/><property name="decimalLatitude" type="decimal"/></extension>'
_THESAURUS = '<thesaurus xmlns:d="d"><concept d:identifier="click"/><concept d:identifier="view"/></thesaurus>'


@_add("dictionary_import", "SELECT field, type, allowed, obligation, key, CASE WHEN field = 'eventType' THEN (SELECT count(*) FROM events WHERE event_type NOT IN ('click', 'view')) ELSE 0 END AS n FROM (VALUES ('eventID', 'string', '', 'required', TRUE), ('eventType', 'controlled-vocabulary', 'click,view', 'optional', FALSE), ('decimalLatitude', 'decimal', '', 'recommended', FALSE)) t(field, type, allowed, obligation, key)")
def _import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary from XML and a checklist, and the events that break its vocabulary."""
    with tempfile.TemporaryDirectory() as made:  # read on the driver only
        texts = {"event.xml": _XML, "kinds.xml": _THESAURUS, "list.csv": "Term,OBIS Required\neventID,Required\n decimalLatitude ,recommended\n"}
        for name, text in texts.items():
            (Path(made) / name).write_text(text, encoding="utf-8")
        built = schema_import.build([f"{made}/event.xml"], f"{made}/list.csv", {"kinds": schema_import.vocabulary(f"{made}/kinds.xml")})
    fields = built["Event"]["fields"]
    events = _table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("eventType"))
    rules = Rules("events", vocabularies=tuple(Vocabulary(n, n, tuple(f["values"])) for n, f in fields.items() if f["values"]))
    counts = integrity_violations(judge(events, rules, "event_id"), rules, "event_id").groupBy("target_name").agg(F.count("tag").alias("found"))
    rows = [(n, f["type"], ",".join(f["values"]), f["obligations"]["obis"], f["unique"] == "true") for n, f in fields.items()]
    named = spark.createDataFrame(rows, "field string, type string, allowed string, obligation string, key boolean")
    return named.join(counts, F.col("field") == F.col("target_name"), "left").select("field", "type", "allowed", "obligation", "key", F.coalesce("found", F.lit(0)).cast("bigint").alias("n"))


_NATIONS = {
    "standard": {"base": "darwin-core", "variant": "obis"},
    "validation": {"maxViolationsPerField": None, "datasets": [{"name": "nations", "class": "Event", "path": "nation.parquet", "fieldMappings": [{"originName": "n_nationkey", "targetName": "eventID"}, {"originName": "n_name", "targetName": "locality", "constraints": [{"type": "pattern", "pattern": "^NATION_1"}]}]}]},
}


def _nations(spark: SparkSession, sf_dir: str) -> validate.Results:
    return validate.validate(spark, config.decode(_NATIONS), sf_dir)


@_add("report_json", "SELECT 'nations' AS dataset, 'PatternViolation' AS tag, n_name AS value, CAST(n_nationkey + 1 AS BIGINT) AS row_number FROM nation WHERE NOT starts_with(n_name, 'NATION_1')")
def _report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = json.loads(report.as_json(_nations(spark, sf_dir)))
    rows = [(d["name"], v["tag"], v["value"], v["row_number"]) for d in told["datasets"] for v in d["violations"]]
    return spark.createDataFrame(rows, "dataset string, tag string, value string, row_number long")


@_add("report_markdown", "SELECT '- error: `n_name` PatternViolation (' || count(*) || ')' AS line FROM nation WHERE NOT starts_with(n_name, 'NATION_1')")
def _report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = report.as_markdown(_nations(spark, sf_dir)).splitlines()
    return spark.createDataFrame([(x,) for x in lines if "PatternViolation" in x], "line string")


@_add("unmapped_columns", "SELECT 'UnmappedColumn' AS tag, 'info' AS severity, column_name AS field_name FROM (DESCRIBE nation) WHERE column_name NOT IN ('n_nationkey', 'n_name')")
def _unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(v.tag, v.severity, v.field_name) for v in _nations(spark, sf_dir).datasets[0].schema if v.tag == "UnmappedColumn"]
    return spark.createDataFrame(own, "tag string, severity string, field_name string")


# A whole workspace

_WORKSPACE = {
    "standard": {"base": "darwin-core", "variant": "obis"},
    "datasetRules": [{"ruleType": "dependency", "dataset": "events", "when": {"field": "o_orderstatus", "equals": "P"}, "require": ["o_missing"]}, {"ruleType": "dependency", "dataset": "events", "when": {"field": "o_orderstatus", "equals": "P"}, "require": ["o_orderstatus", "o_orderpriority"]}],
    "validation": {
        "maxViolationsPerField": None,
        "datasets": [
            {"name": "events", "class": "Event", "path": "orders.parquet", "fieldMappings": [{"originName": "o_orderkey", "targetName": "eventID"}, {"originName": "o_totalprice", "targetName": "maximumDepthInMeters", "constraints": [{"type": "range", "max": 300000}]}, {"originName": "o_orderpriority", "targetName": "locality", "constraints": [{"type": "pattern", "pattern": "^[1-4]-"}]}]},
            {"name": "finds", "class": "Occurrence", "path": "lineitem.parquet", "fieldMappings": [{"originName": "l_orderkey", "targetName": "eventID"}, {"originName": "l_returnflag", "targetName": "basisOfRecord"}, {"originName": "l_quantity", "targetName": "individualCount", "preset": "month"}]},
        ],
    },
}


@_add(
    "workspace_violations",
    """
WITH m AS (SELECT * FROM orders)
SELECT 'events' AS dataset, 'RangeViolation' AS tag, 'maximumDepthInMeters' AS target_name, count(*) FILTER (o_totalprice > 11000) + count(*) FILTER (o_totalprice > 300000) AS n FROM m
UNION ALL SELECT 'events', 'PatternViolation', 'locality', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) FROM m
UNION ALL SELECT 'finds', 'EnumViolation', 'basisOfRecord', count(*) FROM lineitem
UNION ALL SELECT 'finds', 'RangeViolation', 'individualCount', count(*) FILTER (l_quantity > 12 OR l_quantity < 1) FROM lineitem
""",
)
def _workspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = validate.validate(spark, config.decode(_WORKSPACE), sf_dir)
    found = results.datasets[0].violations.unionByName(results.datasets[1].violations)
    return found.groupBy("dataset", "tag", "target_name").agg(F.count("severity").alias("n"))
