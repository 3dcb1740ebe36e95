
from __future__ import annotations

import uuid
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sparkscrub as ss
from sparkscrub.functions.text import WHITESPACE as WS
from sparkscrub.functions.text import WS_CLASS
from sparkscrub.operators.common import unique_name as first_free_name
from sparkscrub.plans.lookup import use_own_folder, work_folder
from sparkscrub.sources.records import QuoteCounts
from sparkscrub.sources.tables import format_of
from sparkscrub.streaming.streams import apply_recipe, drop_duplicates, first_by_order, read_stream


def _unless_deleted(name: str, *parts: str):
    """The module ``name``, or None where one of ``parts`` is not there; other import errors are errors."""
    try:
        return import_module(name)
    except ModuleNotFoundError as problem:
        if problem.name not in parts:
            raise
        return None


_corpus = _unless_deleted("sparkscrub.llm.entry", "sparkscrub.llm", "sparkscrub.llm.entry")
_pipeline = _unless_deleted("corpus_pipeline", "corpus_pipeline", "sparkscrub.llm")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(run):
        _QUERIES[run.__name__] = run
        if sql is not None:
            _SQL[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its name says how it is read."""
    path = f"{sf_dir}/{name}.parquet"
    return ss.read_table(spark, path, format_of(path))


def _new_folder(spark: SparkSession) -> str:
    return f"{work_folder(spark)}/table-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- text cells


def _sql_mask(x: str) -> str:
    return (
        f"CASE WHEN length({x}) > 4 THEN left({x}, 2) || repeat('*', length({x}) - 4) || right({x}, 2) "
        f"WHEN length({x}) > 2 THEN left({x}, 1) || repeat('*', length({x}) - 2) || right({x}, 1) "
        f"WHEN length({x}) = 1 THEN '*' ELSE {x} END"
    )


@_query(f"""
SELECT c_custkey, {_sql_mask('c_name')} AS c_name, {_sql_mask('c_nationkey::VARCHAR')} AS c_nationkey,
       {_sql_mask('c_acctbal::VARCHAR')} AS c_acctbal, {_sql_mask('c_mktsegment')} AS c_mktsegment
FROM customer""")
def mask(spark, sf_dir):
    df = _table(spark, sf_dir, "customer")
    for col in ("c_name", "c_nationkey", "c_acctbal", "c_mktsegment"):
        df = ss.mask(df, col)
    return df


# Customers have no address, so one is built from the name; machinery customers get a broken one.
_ADDRESS = """CASE c_mktsegment
  WHEN 'BUILDING' THEN lower(replace(c_name, '#', '.')) || '@gmail.com'
  WHEN 'AUTOMOBILE' THEN lower(replace(c_name, '#', '.')) || '@dept.uni' || c_nationkey || '.edu'
  WHEN 'FURNITURE' THEN lower(replace(c_name, '#', '_')) || '@shop.co.uk'
  WHEN 'HOUSEHOLD' THEN lower(replace(c_name, '#', '..')) || '@home.com'
  ELSE c_name || '@@' || c_nationkey END"""


def _addresses(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer")
    return customer.select("c_custkey", F.expr(_ADDRESS).alias("email"))


@_query(rf"""
SELECT c_custkey,
       CASE WHEN regexp_full_match(email, '[^@]+@[^@\n]+')
            THEN left(split_part(email, '@', 1), 2) || '***@' || split_part(email, '@', 2)
            ELSE email END AS email,
       NOT regexp_full_match(email, '[^@]+@[^@\n]+') AS email__invalid
FROM (SELECT c_custkey, {_ADDRESS} AS email FROM customer)""")
def mask_email(spark, sf_dir):
    return ss.mask_email(_addresses(spark, sf_dir), "email", flags=True)


_SQL_WORDS = f"list_filter(regexp_split_to_array(text, '[{WS_CLASS}]+'), lambda w: w <> '')"


@_query(f"""
SELECT doc_id, array_to_string(list_transform({_SQL_WORDS},
         lambda w: left(w, 2) || repeat('*', greatest(length(w) - 2, 0))), ' ') AS text
FROM documents""")
def mask_words(spark, sf_dir):
    return ss.mask_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


_PADDED = "CASE lang WHEN 'en' THEN text ELSE chr(160) || ' ' || text || chr(9) || chr(12288) END"


@_query(f"""
SELECT doc_id, trim(padded, '{WS}') AS padded, padded <> trim(padded, '{WS}') AS padded__modified
FROM (SELECT doc_id, {_PADDED} AS padded FROM documents)""")
def trim(spark, sf_dir):
    # char() stops at 255 in Spark, so the wide space is a literal here.
    padded = F.expr(_PADDED.replace("chr(12288)", "'　'"))
    return ss.trim(_table(spark, sf_dir, "documents").select("doc_id", padded.alias("padded")), "padded", flags=True)


@_query("SELECT doc_id, upper(replace(text, 'ß', 'SS')) AS text FROM documents")
def upper(spark, sf_dir):
    return ss.upper(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query("SELECT doc_id, lower(text) AS text FROM documents")
def lower(spark, sf_dir):
    return ss.lower(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query(r"""
SELECT doc_id, array_to_string(list_transform(
         regexp_extract_all(text, '[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+'),
         lambda r: CASE left(r, 1) WHEN 'ß' THEN 'Ss' ELSE upper(left(r, 1)) END || lower(substr(r, 2))), '') AS text
FROM documents""")
def title(spark, sf_dir):
    return ss.title(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query("""
SELECT event_id, replace(props, '"k": ', 'key=') AS props, contains(props, '"k": ') AS props__modified
FROM events""")
def find_replace(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "props")
    return ss.find_replace(events, "props", '"k": ', "key=", flags=True)


@_query("SELECT doc_id, translate(text, 'aeiou.,-', '') AS text FROM documents")
def remove_specific(spark, sf_dir):
    return ss.remove_specific(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "aeiou.,-")


@_query("""
SELECT doc_id, regexp_replace(text, '[^0-9.-]', '', 'g') AS text,
       regexp_matches(text, '[^0-9.-]') AS text__modified
FROM documents""")
def remove_non_numeric(spark, sf_dir):
    return ss.remove_non_numeric(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", flags=True)


@_query(rf"""
SELECT doc_id, regexp_replace(text, '[^\p{{L}}{WS_CLASS}]', '', 'g') AS text FROM documents""")
def remove_non_alpha(spark, sf_dir):
    return ss.remove_non_alpha(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def _labelled(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = _table(spark, sf_dir, "labels")
    note = F.when(F.col("toxic") == 1, F.lit("  ")).otherwise(F.col("quality").cast("string"))
    return documents.join(labels, "doc_id", "left").withColumn("note", note)


@_query("""
SELECT d.doc_id, lang, coalesce(quality, -1) AS quality, toxic,
       CASE WHEN quality IS NULL OR toxic = 1 THEN '5' ELSE quality::VARCHAR END AS note,
       quality IS NULL OR toxic = 1 AS note__modified
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def fill_missing(spark, sf_dir):
    df = ss.fill_missing(_labelled(spark, sf_dir), "quality", -1)
    return ss.fill_missing(df, "note", "5.0", flags=True)


# ---------------------------------------------------------------- columns


@_query("SELECT p_partkey, p_name AS part_name, p_brand, p_type, p_size, p_retailprice FROM part")
def rename_column(spark, sf_dir):
    return ss.rename_column(_table(spark, sf_dir, "part"), "p_name", "part_name")


_SQL_SHORT = "CASE WHEN {0} = round_even({0}, 0) THEN ({0})::BIGINT::VARCHAR ELSE ({0})::VARCHAR END"


@_query(f"""
SELECT l_orderkey, l_linenumber,
       l_returnflag || '-' || {_SQL_SHORT.format('l_quantity')} || '-' || {_SQL_SHORT.format('l_extendedprice')}
       || '-' || l_partkey || '-' || l_shipdate AS joined
FROM lineitem""")
def concatenate(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    cols = ["l_returnflag", "l_quantity", "l_extendedprice", "l_partkey", "l_shipdate"]
    return ss.concatenate(df, cols, "joined", "-").select("l_orderkey", "l_linenumber", "joined")


@_query("""
SELECT d.doc_id, lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic,
       coalesce(quality::VARCHAR, '') || '/' || coalesce(toxic::VARCHAR, '') AS merged
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def merge_columns(spark, sf_dir):
    df = _labelled(spark, sf_dir).drop("note")
    return ss.merge_columns(df, ["quality", "toxic"], "merged", "/", fill_missing=True)


@_query("""
SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS o_orderpriority_part1,
       split_part(o_orderpriority, '-', 2) AS o_orderpriority_part2
FROM orders""")
def split_delimiter(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return ss.split_delimiter(orders, "o_orderpriority", "-", n_parts=2)


@_query("""
SELECT page_id, split_part(url, '/', 1) AS url_part1, split_part(url, '/', 2) AS url_part2,
       split_part(url, '/', 3) AS url_part3, split_part(url, '/', 4) AS url_part4,
       split_part(url, '/', 5) AS url_part5, split_part(url, '/', 6) AS url_part6
FROM pages""")
def split_delimiter_auto(spark, sf_dir):
    return ss.split_delimiter(_table(spark, sf_dir, "pages").select("page_id", "url"), "url", "/")


@_query("""
SELECT p_partkey, array_to_string(list_slice(string_split(p_name, ' '), 1, -2), ' ') AS p_name,
       list_last(string_split(p_name, ' ')) AS p_name_Surname
FROM part""")
def split_surname(spark, sf_dir):
    return ss.split_surname(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name")


@_query(r"""
SELECT doc_id, text, regexp_extract(text, '[a-z.0-9]+@([a-z0-9]+\.[a-z.]+)', 1) AS host FROM documents""")
def extract_pattern(spark, sf_dir):
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ss.extract_pattern(documents, "text", r"[a-z.0-9]+@([a-z0-9]+\.[a-z.]+)", "host")


@_query("""
SELECT c_custkey, c_name, regexp_extract(c_name, '[0-9]+')::BIGINT::VARCHAR AS number,
       regexp_extract(c_name, '#([0-9]+)', 1) AS digits
FROM customer""")
def extract_numbers(spark, sf_dir):
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    df = ss.extract_pattern(customer, "c_name", r"\d+", "number")
    return ss.extract_pattern(df, "c_name", r"(?P<sign>#)(?P<digits>\d+)", "digits", group=2, normalize_ints=False)


# ---------------------------------------------------------------- numbers


@_query("""
SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * 10, 0) / 10 AS l_extendedprice,
       round_even(l_discount, 0) AS l_discount, l_tax
FROM lineitem""")
def round_numbers(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax"
    )
    return ss.round_numbers(ss.round_numbers(df, "l_extendedprice", 1), "l_discount", 0)


@_query("""
SELECT l_orderkey, l_linenumber, l_quantity / 7.0::DOUBLE AS l_quantity,
       l_extendedprice * 1.5::DOUBLE AS l_extendedprice, l_partkey + 0.5::DOUBLE AS l_partkey,
       l_tax - 2.0::DOUBLE AS l_tax
FROM lineitem""")
def calculate_constant(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_tax"
    )
    df = ss.calculate_constant(df, "l_quantity", "/", 7)
    df = ss.calculate_constant(df, "l_extendedprice", "*", 1.5)
    df = ss.calculate_constant(df, "l_partkey", "+", 0.5)
    return ss.calculate_constant(df, "l_tax", "-", 2)


@_query("""
WITH places AS (
  SELECT max(greatest(length(split_part(l_extendedprice::VARCHAR, '.', 2)),
                      length(split_part(l_discount::VARCHAR, '.', 2)))) AS d FROM lineitem)
SELECT l_orderkey, l_linenumber,
       round_even(l_extendedprice * l_discount * power(10, d), 0) / power(10, d) AS saved,
       CASE WHEN l_discount <> 0
            THEN round_even(l_extendedprice / l_discount * power(10, d), 0) / power(10, d) END AS ratio,
       l_partkey - l_suppkey AS gap, l_partkey::DOUBLE / nullif(l_suppkey, 0) AS share
FROM lineitem, places""")
def calculated_column(spark, sf_dir):
    df = _table(spark, sf_dir, "lineitem")
    df = ss.calculated_column(df, "l_extendedprice", "l_discount", "*", "saved")
    df = ss.calculated_column(df, "l_extendedprice", "l_discount", "/", "ratio")
    df = ss.calculated_column(df, "l_partkey", "l_suppkey", "-", "gap")
    df = ss.calculated_column(df, "l_partkey", "l_suppkey", "/", "share")
    return df.select("l_orderkey", "l_linenumber", "saved", "ratio", "gap", "share")


@_query("""
SELECT l_orderkey, l_linenumber, round_even((l_extendedprice + l_tax) * 100, 0) / 100 AS total FROM lineitem""")
def calculated_column_fixed(spark, sf_dir):
    df = ss.calculated_column(_table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_tax", "+", "total", decimals=2)
    return df.select("l_orderkey", "l_linenumber", "total")


# Prices as decimals of 25 digits before the point, which no double holds.
_WIDE = "l_extendedprice::DECIMAL(12, 3) + 1234567890123456789012345::DECIMAL(38, 3)"


@_query(f"""
SELECT l_orderkey, l_linenumber, (round_even(v, 1))::DECIMAL(38, 3)::VARCHAR AS rounded,
       (v + 0.125::DECIMAL(4, 3))::VARCHAR AS plus, (v - l_partkey::DECIMAL(19, 0))::DECIMAL(38, 3)::VARCHAR AS less
FROM (SELECT l_orderkey, l_linenumber, l_partkey, {_WIDE} AS v FROM lineitem)""")
def round_decimals(spark, sf_dir):
    """Decimals beyond a double's digits stay exact through rounding and arithmetic."""
    price = F.col("l_extendedprice").cast("decimal(12,3)")
    wide = (price + F.lit("1234567890123456789012345").cast("decimal(28,3)")).cast("decimal(38,3)")
    df = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", wide.alias("rounded"), wide.alias("plus"), wide.alias("v")
    )
    df = ss.round_numbers(df, "rounded", 1)
    df = ss.calculate_constant(df, "plus", "+", 0.125)
    df = ss.calculated_column(df, "v", "l_partkey", "-", "less")
    shown = [F.col(c).cast("decimal(38,3)").cast("string").alias(c) for c in ("rounded", "plus", "less")]
    return df.select("l_orderkey", "l_linenumber", *shown)


# ---------------------------------------------------------------- validation


def _sql_verdict(key: str, cell: str, value: str, rule: str, source: str, good: str = "Valid") -> str:
    """Verdict columns around a CASE body that gives the reason."""
    return f"""
SELECT {key}, {cell}, reason NOT LIKE 'Valid%' AND reason <> 'Allowed Domain' AS {cell}__invalid,
       reason AS {cell}__reason
FROM (SELECT {key}, {cell}, CASE WHEN {cell} IS NULL OR trim({cell}, '{WS}') = '' THEN 'Empty'
             {rule} END AS reason
      FROM (SELECT {key}, {value} AS {cell} FROM {source}))"""


_SQL_EMAIL = r"""
 WHEN contains(email, '..') OR NOT regexp_full_match(email,
      '[\p{L}\p{N}_][\p{L}\p{N}_.%+-]{0,63}@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') THEN 'Invalid Format'"""


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _ADDRESS,
        _SQL_EMAIL
        + r"""
 WHEN email LIKE '%@gmail.com' THEN 'Valid Common Domain'
 WHEN email LIKE '%.edu' THEN 'Valid Educational Institution'
 WHEN email LIKE '%.com' THEN 'Valid Commercial' ELSE 'Unknown TLD'""",
        "customer",
    )
)
def validate_email(spark, sf_dir):
    return ss.validate_email(_addresses(spark, sf_dir), "email")


# One domain of each kind of owner, and domains that are no good, in turn over the customers.
_DOMAINS = (
    "uni.edu", "dept.uni.edu.au", "kings.ac.uk", "city.gov", "tax.gov.in", "army.mil", "aid.org", "shop.com",
    "isp.net", "edu.uk", "plain.uk", "gov", "-bad.com", "a_b.com", "x.y.z.museum", "ac.org", "gmail.com", "",
)
_KIND_ADDRESS = (
    "'user' || c_custkey || '@' || CASE c_custkey % " + str(len(_DOMAINS))
    + "".join(f" WHEN {i} THEN '{d}'" for i, d in enumerate(_DOMAINS)) + " END"
)
_SQL_DOMAIN = "split_part(email, '@', 2)"


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _KIND_ADDRESS,
        _SQL_EMAIL
        + rf"""
 WHEN {_SQL_DOMAIN} = 'gmail.com' THEN 'Valid Common Domain'
 WHEN NOT regexp_full_match({_SQL_DOMAIN}, '[a-z0-9]+(-+[a-z0-9]+)*(\.[a-z0-9]+(-+[a-z0-9]+)*)+') THEN 'Invalid Format'
 WHEN regexp_extract({_SQL_DOMAIN}, '[^.]+$') NOT IN ('com', 'org', 'net', 'edu', 'gov', 'mil', 'uk', 'au', 'in')
      THEN 'Unknown TLD'
 ELSE 'Valid ' || CASE
   WHEN regexp_matches({_SQL_DOMAIN}, '\.edu$') THEN 'Educational Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.edu\.[a-z][a-z]$') THEN 'International Educational Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.ac\.[a-z][a-z]$') THEN 'Academic Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.gov$') THEN 'Government Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.gov\.[a-z][a-z]$') THEN 'International Government Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.mil$') THEN 'Military Institution'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.org$') THEN 'Organization'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.com$') THEN 'Commercial'
   WHEN regexp_matches({_SQL_DOMAIN}, '\.net$') THEN 'Network' ELSE 'Domain' END""",
        "customer",
    )
)
def validate_email_kinds(spark, sf_dir):
    """All kinds of owner; countries' suffixes as wildcards."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_KIND_ADDRESS).alias("email"))
    return ss.validate_email(customer, "email", suffixes=("*.uk", "*.au", "in"))


# Domains under rules of several labels, with a label before the suffix (even places) and without.
_UNDER_RULES = (
    "shop.co.uk", "co.uk", "a.b.ck", "b.ck", "www.ck", "a.kobe.jp", "x.www.ck", "x.net", "city.kobe.jp", "k12.ma.us",
    "x.y.kobe.jp", "y.x.net", "my.k12.ma.us", "ma.us", "kobe.jp", "a.b.c.net",
)
_RULE_ADDRESS = (
    "'user' || c_custkey || '@' || CASE c_custkey % " + str(len(_UNDER_RULES) + 2)
    + "".join(f" WHEN {i} THEN '{d}'" for i, d in enumerate(_UNDER_RULES))
    + f" WHEN {len(_UNDER_RULES)} THEN 'gmail.com' ELSE 'shop.france' END"
)
_RULES = ("uk", "co.uk", "*.ck", "!www.ck", "jp", "*.kobe.jp", "!city.kobe.jp", "k12.ma.us", "*.us")


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _RULE_ADDRESS,
        _SQL_EMAIL
        + rf"""
 WHEN {_SQL_DOMAIN} = 'gmail.com' THEN 'Valid Common Domain'
 WHEN {_SQL_DOMAIN} IN ({', '.join(f"'{d}'" for d in _UNDER_RULES[::2])}) THEN 'Valid Domain'
 WHEN regexp_extract(email, '[^.]+$') IN (SELECT lower(n_name) FROM nation) THEN 'Valid Domain' ELSE 'Unknown TLD'""",
        "customer",
    )
)
def validate_email_suffix_rules(spark, sf_dir):
    """Rules of one to three labels, wildcards and exceptions, as a table: the nations' names and others."""
    nation = _table(spark, sf_dir, "nation")
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RULE_ADDRESS).alias("email"))
    more = nation.limit(1).select(F.explode(F.array(*map(F.lit, _RULES))).alias("rule"))
    rules = nation.select(F.lower("n_name").alias("rule")).unionAll(more)
    return ss.validate_email(customer, "email", suffix_rules=rules)


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _ADDRESS,
        _SQL_EMAIL
        + r"""
 WHEN email LIKE '%@gmail.com' THEN 'Valid Common Domain'
 WHEN email LIKE '%.edu' THEN 'Valid Educational Institution'
 WHEN email LIKE '%.com' THEN 'Valid Commercial'
 WHEN regexp_extract(email, '[^.]+$') IN (SELECT lower(n_name) FROM nation UNION ALL SELECT 'uk') THEN 'Valid Domain'
 ELSE 'Unknown TLD'""",
        "customer",
    )
)
def validate_email_suffix_table(spark, sf_dir):
    """Suffixes as a table: the nations' names and uk."""
    nation = _table(spark, sf_dir, "nation")
    suffixes = nation.select(F.lower("n_name").alias("suffix"))
    suffixes = suffixes.unionAll(nation.limit(1).select(F.lit("uk").alias("suffix")))
    return ss.validate_email(_addresses(spark, sf_dir), "email", suffixes=suffixes)


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _ADDRESS,
        _SQL_EMAIL
        + r"""
 WHEN email LIKE '%@gmail.com' THEN 'Valid Common Domain'
 WHEN split_part(email, '@', 2) IN (SELECT 'dept.uni' || n_nationkey || '.edu' FROM nation)
      THEN 'Blocked Domain'
 WHEN split_part(email, '@', 2) IN ('shop.co.uk', 'dept.uni5.edu') THEN 'Allowed Domain'
 WHEN email LIKE '%.edu' THEN 'Valid Educational Institution'
 WHEN email LIKE '%.com' THEN 'Valid Commercial'
 WHEN email LIKE '%.co.uk' THEN 'Valid Domain' ELSE 'Unknown TLD'""",
        "customer",
    )
)
def validate_email_lists(spark, sf_dir):
    """Block list as a table, allow list as a collection, suffixes as a collection."""
    nation = _table(spark, sf_dir, "nation")
    blocked = nation.select(F.concat(F.lit("dept.uni"), "n_nationkey", F.lit(".edu")).alias("domain"))
    rules = ss.DomainRules(allowed=("shop.co.uk", "dept.uni5.edu"), suffixes=("com", "co.uk"))
    return ss.validate_email(_addresses(spark, sf_dir), "email", rules=rules, blocked=blocked)


@_query(rf"""
SELECT c_custkey, email, reason NOT LIKE 'Valid%' AS email__invalid, reason AS email__reason
FROM (SELECT c_custkey, email, CASE {_SQL_EMAIL.replace('Invalid Format', 'Invalid Email Format')}
   WHEN email LIKE '%@gmail.com' THEN 'Valid Common Domain'
   WHEN email LIKE '%.edu' THEN 'Valid Educational Institution'
   WHEN email LIKE '%.com' THEN 'Valid Commercial' ELSE 'Unknown TLD' END AS reason
  FROM (SELECT c_custkey, {_ADDRESS} AS email FROM customer))""")
def check_email_address(spark, sf_dir):
    return ss.check_email_address(_addresses(spark, sf_dir), "email")


_PHONE = "'[+]?[0-9][-0-9 ().]{4,}[0-9]'"


@_query(
    _sql_verdict(
        "doc_id, nth",
        "phone",
        "phone",
        rf"""WHEN length(regexp_replace(phone, '\D', '', 'g')) NOT BETWEEN 7 AND 15 THEN 'Invalid Length'
 WHEN NOT regexp_full_match(phone, '\+?[0-9{WS_CLASS}()-]{{7,20}}') THEN 'Invalid Format' ELSE 'Valid'""",
        f"""(SELECT doc_id, n AS nth, runs[n] AS phone
              FROM (SELECT doc_id, regexp_extract_all(text, {_PHONE}) AS runs FROM documents),
                   LATERAL (SELECT unnest(range(1, len(runs) + 1)) AS n))""",
    )
)
def validate_phone(spark, sf_dir):
    """Every run of figures in every text."""
    runs = F.posexplode(F.expr(f"regexp_extract_all(text, {_PHONE}, 0)")).alias("at", "phone")
    found = _table(spark, sf_dir, "documents").select("doc_id", runs)
    found = found.select("doc_id", (F.col("at") + 1).cast("bigint").alias("nth"), "phone")
    return ss.validate_phone(found, "phone")


# Order dates in the layout of the order's status; the last digit group is out of range for some.
_DATE = """CASE o_orderstatus
  WHEN 'O' THEN substr(o_orderdate::VARCHAR, 1, 10)
  WHEN 'F' THEN substr(o_orderdate::VARCHAR, 9, 2) || '/' || substr(o_orderdate::VARCHAR, 6, 2) || '/'
                || substr(o_orderdate::VARCHAR, 1, 4)
  ELSE substr(o_orderdate::VARCHAR, 1, 8) || '3' || substr(o_orderdate::VARCHAR, 10, 1) END"""


@_query(
    _sql_verdict(
        "o_orderkey",
        "day",
        _DATE,
        "WHEN try_strptime(day, ['%Y-%m-%d', '%d/%m/%Y']) IS NULL THEN 'Invalid Format' ELSE 'Valid'",
        "orders",
    )
)
def validate_date(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    day = F.expr(_DATE.replace("::VARCHAR", "::STRING"))
    return ss.validate_date(orders.select("o_orderkey", day.alias("day")), "day")


@_query("""
SELECT event_id, ts::VARCHAR AS ts, FALSE AS ts__invalid, 'Valid' AS ts__reason
FROM (SELECT event_id, ts FROM events WHERE ts IS NOT NULL)
UNION ALL SELECT event_id, '', TRUE, 'Empty' FROM events WHERE ts IS NULL""")
def validate_timestamps(spark, sf_dir):
    """A timestamp column, which the library turns into text itself."""
    return ss.validate_date(_table(spark, sf_dir, "events").select("event_id", "ts"), "ts")


# Written dates: ordinals, short months with a point, days of the week, month and year alone.
_WRITTEN = """CASE o_orderkey % 6
  WHEN 0 THEN strftime(o_orderdate, '%-d') || CASE day(o_orderdate) WHEN 1 THEN 'st' WHEN 2 THEN 'nd' WHEN 3 THEN 'rd'
              ELSE 'th' END || strftime(o_orderdate, ' %B %Y')
  WHEN 1 THEN strftime(o_orderdate, '%b. %-d, %Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m')
  WHEN 3 THEN strftime(o_orderdate, '%-d %b, %Y') WHEN 4 THEN strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S')
  ELSE strftime(o_orderdate, '%B %Yth') END"""


@_query(
    _sql_verdict(
        "o_orderkey",
        "day",
        _WRITTEN,
        "WHEN day LIKE '%th' AND day NOT LIKE '% %th %' THEN 'Invalid Format' ELSE 'Valid'",
        "orders",
    )
)
def validate_written_dates(spark, sf_dir):
    date, day = F.col("o_orderdate"), F.dayofmonth("o_orderdate")
    ending = F.when(day == 1, "st").when(day == 2, "nd").when(day == 3, "rd").otherwise("th")

    def shown(layout):
        return F.date_format(date, layout)

    kind = F.col("o_orderkey") % 6
    text = (
        F.when(kind == 0, F.concat(shown("d"), ending, shown(" MMMM yyyy")))
        .when(kind == 1, shown("MMM. d, yyyy"))
        .when(kind == 2, shown("yyyy-MM"))
        .when(kind == 3, shown("d MMM, yyyy"))
        .when(kind == 4, shown("E, dd MMM yyyy HH:mm:ss"))
        .otherwise(F.concat(shown("MMMM yyyy"), F.lit("th")))
    )
    return ss.validate_date(_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("day")), "day")


_MEASURE = """CASE event_type WHEN 'view' THEN value::VARCHAR WHEN 'click' THEN '1_' || event_id || 'e-2'
  WHEN 'error' THEN 'E' || event_id WHEN 'signup' THEN ' ' ELSE '1__' || event_id END"""


@_query(
    _sql_verdict(
        "event_id",
        "measure",
        _MEASURE,
        r"""WHEN regexp_full_match(measure, '[+-]?[0-9]+(_[0-9]+)*(\.[0-9]*)?(e[+-]?[0-9]+)?') THEN 'Valid'
 ELSE 'Invalid Format'""",
        "events",
    )
)
def validate_numeric(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    measure = F.expr(_MEASURE.replace("::VARCHAR", "::STRING"))
    return ss.validate_numeric(events.select("event_id", measure.alias("measure")), "measure")


@_query(
    _sql_verdict(
        "doc_id",
        "text",
        "text",
        rf"WHEN regexp_full_match(text, '[\p{{L}}{WS_CLASS}]+') THEN 'Valid' ELSE 'Invalid Character'",
        "documents",
    )
)
def validate_alphanumeric(spark, sf_dir):
    return ss.validate_alphanumeric(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


_LINK = "CASE WHEN url LIKE '%example.net%' THEN replace(url, '//', '/') ELSE url END"


@_query(
    _sql_verdict(
        "page_id",
        "link",
        _LINK,
        "WHEN regexp_matches(link, '^(?i:https?)://[^/?#]') THEN 'Valid' ELSE 'Invalid Format'",
        "pages",
    )
)
def validate_url(spark, sf_dir):
    return ss.validate_url(_table(spark, sf_dir, "pages").select("page_id", F.expr(_LINK).alias("link")), "link")


def _validated_parts(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    for col, kind in _PART_KINDS.items():
        part = ss.validate(part, col, kind)
    return part


def _sql_part_reason(column: str, kind: str) -> str:
    """Reason of a cell of the part table, by the kind of check."""
    good = {
        "alphanumeric": f"regexp_full_match({column}, '[\\p{{L}}{WS_CLASS}]+')",
        "numeric": f"regexp_full_match({column}::VARCHAR, '[+-]?[0-9]+(\\.[0-9]*)?')",
        "url": f"regexp_matches({column}, '^(?i:https?)://[^/?#]')",
    }[kind]
    bad = "Invalid Character" if kind == "alphanumeric" else "Invalid Format"
    return f"""SELECT '{column}' AS "column", CASE WHEN {column} IS NULL OR trim({column}::VARCHAR, '{WS}') = '' THEN 'Empty'
 WHEN {good} THEN 'Valid' ELSE '{bad}' END AS reason,
 count(*) OVER (PARTITION BY {column}) > 1 AS dup FROM part"""


_PART_KINDS = {"p_name": "alphanumeric", "p_brand": "alphanumeric", "p_size": "numeric", "p_type": "url"}
_PART_CELLS = "\nUNION ALL ".join(_sql_part_reason(c, k) for c, k in _PART_KINDS.items())


@_query(f"""
SELECT "column", count(*) FILTER (reason = 'Valid') AS valid, count(*) AS total,
       count(*) FILTER (reason = 'Valid') * 100.0::DOUBLE / count(*) AS rate,
       CASE WHEN "column" = 'p_brand' THEN count(*) FILTER (dup) END AS duplicates, NULL::BIGINT AS modified
FROM ({_PART_CELLS}) GROUP BY 1
UNION ALL
SELECT 'p_retailprice', NULL, count(*), NULL, NULL, count(*) FILTER (p_retailprice IS NULL) FROM part""")
def validation_summary(spark, sf_dir):
    """Valid, duplicate and changed cells per column."""
    part = ss.mark_duplicates(_validated_parts(spark, sf_dir), "p_brand")
    return ss.validation_summary(ss.fill_missing(part, "p_retailprice", 0, flags=True))


@_query(f"""
SELECT "column", reason, count(*) AS cells FROM ({_PART_CELLS}) GROUP BY 1, 2""")
def reason_counts(spark, sf_dir):
    return ss.reason_counts(_validated_parts(spark, sf_dir))


@_query("""
SELECT o_orderkey, 'o_orderpriority' AS "column", 'modified' AS kind, NULL::VARCHAR AS reason,
       replace(o_orderpriority, 'NOT SPECIFIED', 'NONE') AS value
FROM orders WHERE contains(o_orderpriority, 'NOT SPECIFIED')
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'invalid', 'Invalid Format', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'o_custkey', 'duplicate', NULL, o_custkey::VARCHAR
FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)""")
def issue_report(spark, sf_dir):
    df = _table(spark, sf_dir, "orders")
    df = ss.find_replace(df, "o_orderpriority", "NOT SPECIFIED", "NONE", flags=True)
    df = ss.validate_numeric(df, "o_orderstatus")
    return ss.issue_report(ss.mark_duplicates(df, "o_custkey"), "o_orderkey")


# ---------------------------------------------------------------- duplicates and codes


@_query("""
SELECT doc_id, text, count(*) OVER (PARTITION BY text) > 1 AS text__duplicate FROM documents""")
def mark_duplicates(spark, sf_dir):
    return ss.mark_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@_query("""
WITH pool AS (SELECT o_orderkey::VARCHAR AS v FROM orders UNION ALL SELECT o_custkey::VARCHAR FROM orders
              UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderdate::VARCHAR FROM orders),
     dup AS (SELECT v FROM pool GROUP BY v HAVING count(*) > 1)
SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate::VARCHAR AS o_orderdate,
       o_orderkey::VARCHAR IN (SELECT v FROM dup) AS o_orderkey__duplicate,
       o_custkey::VARCHAR IN (SELECT v FROM dup) AS o_custkey__duplicate,
       o_orderpriority IN (SELECT v FROM dup) AS o_orderpriority__duplicate,
       o_orderdate::VARCHAR IN (SELECT v FROM dup) AS o_orderdate__duplicate
FROM orders""")
def mark_duplicates_pooled(spark, sf_dir):
    """Numbers, text and timestamps in one pool."""
    cols = ["o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate"]
    marked = ss.mark_duplicates(_table(spark, sf_dir, "orders").select(*cols), cols)
    return marked.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@_query("""
SELECT doc_id, quality, toxic, CASE quality WHEN 1 THEN 'y' ELSE 'n' END AS quality__duplicate,
       'as given' AS toxic__reason, count(*) OVER (PARTITION BY toxic) > 1 AS toxic__duplicate
FROM labels""")
def marks_beside_own_columns(spark, sf_dir):
    """The user's columns that are called like marks stay what they are, through marking and writing."""
    own = F.when(F.col("quality") == 1, "y").otherwise("n")
    labels = _table(spark, sf_dir, "labels").withColumns({"quality__duplicate": own, "toxic__reason": F.lit("as given")})
    path = _new_folder(spark)
    ss.write_table(ss.mark_duplicates(labels, "toxic"), path, "parquet", keep_marks=True)
    return ss.read_table(spark, path, "parquet")


@_query("""
SELECT 'quality__duplicate' AS "column", 'string' AS type, count(DISTINCT quality) AS distinct_values,
       FALSE AS has_missing, 18 AS max_width FROM labels
UNION ALL SELECT 'toxic', 'int', count(DISTINCT toxic), FALSE, 5 FROM labels""")
def profile_beside_marks(spark, sf_dir):
    """Marks are left out of a profile, the user's column of such a name is not."""
    own = F.when(F.col("quality") == 1, "y").otherwise("n")
    labels = _table(spark, sf_dir, "labels").select("toxic", own.alias("quality__duplicate"))
    return ss.profile(ss.mark_duplicates(labels, "toxic"))


@_query("""
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def remove_duplicates(spark, sf_dir):
    return ss.remove_duplicates(_table(spark, sf_dir, "documents"), "text", order_by="doc_id")


@_query("""
SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, value, props
FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)
WHERE n = 1""")
def remove_duplicates_by_two(spark, sf_dir):
    first = ss.remove_duplicates(_table(spark, sf_dir, "events"), ["user_id", "event_type"], order_by="event_id")
    return first.withColumn("ts", F.col("ts").cast("string"))


@_query("""
SELECT o_orderkey, o_totalprice, dense_rank() OVER (ORDER BY o_totalprice) AS o_totalprice_distinct_group
FROM orders""")
def distinct_group(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ss.distinct_group(orders, "o_totalprice")


@_query("""
WITH codes AS (SELECT quality, row_number() OVER (ORDER BY quality) AS code
               FROM (SELECT DISTINCT quality FROM labels))
SELECT d.doc_id, l.quality, coalesce(c.code, 0) AS quality_distinct_group
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN codes c ON c.quality = l.quality""")
def distinct_group_missing(spark, sf_dir):
    return ss.distinct_group(_labelled(spark, sf_dir).select("doc_id", "quality"), "quality")


@_query("""
SELECT text AS value, row_number() OVER (ORDER BY text) AS code FROM (SELECT DISTINCT text FROM documents)""")
def distinct_codes(spark, sf_dir):
    return ss.distinct_codes(_table(spark, sf_dir, "documents"), "text")


# ---------------------------------------------------------------- slices and reports

_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


def _orders(spark, sf_dir):
    return _table(spark, sf_dir, "orders").select(*_ORDER_COLUMNS)


@_query(f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders ORDER BY o_orderkey LIMIT 1000")
def slice_head(spark, sf_dir):
    return ss.slice_rows(_orders(spark, sf_dir), "head", order_by="o_orderkey")


@_query(f"""
SELECT {', '.join(_ORDER_COLUMNS)} FROM orders ORDER BY o_orderkey
LIMIT 1000 OFFSET (SELECT (count(*) - 1000) // 2 FROM orders)""")
def slice_middle(spark, sf_dir):
    """Without slack, so that small tables are narrowed down as large ones are."""
    return ss.slice_rows(_orders(spark, sf_dir), "middle", order_by="o_orderkey", slack=0)


@_query(f"""
SELECT {', '.join(_ORDER_COLUMNS)} FROM orders ORDER BY o_orderpriority, o_orderkey
LIMIT 1000 OFFSET (SELECT (count(*) - 1000) // 2 FROM orders)""")
def slice_middle_two_keys(spark, sf_dir):
    return ss.slice_rows(_orders(spark, sf_dir), "middle", order_by=["o_orderpriority", "o_orderkey"], slack=0)


@_query(f"SELECT {', '.join(_ORDER_COLUMNS)} FROM orders ORDER BY o_orderkey DESC LIMIT 1000")
def slice_tail(spark, sf_dir):
    return ss.slice_rows(_orders(spark, sf_dir), "tail", order_by="o_orderkey")


def _sql_profile(column: str, dtype: str) -> str:
    return f"""SELECT '{column}' AS "column", '{dtype}' AS type,
 count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS distinct_values,
 bool_or({column} IS NULL) AS has_missing,
 greatest(max(length({column}::VARCHAR)), {len(column)}) AS max_width
FROM documents d LEFT JOIN labels l USING (doc_id)"""


_PROFILED = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("n_chars", "bigint"), ("quality", "int"))


@_query("\nUNION ALL ".join(_sql_profile(c, t) for c, t in _PROFILED))
def profile(spark, sf_dir):
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return ss.profile(documents.join(labels, "doc_id", "left"), [c for c, _ in _PROFILED])


@_query("""
SELECT column_name AS "column", TRUE AS close, TRUE AS same_otherwise
FROM (DESCRIBE SELECT * FROM lineitem)""")
def profile_approx(spark, sf_dir):
    """Is each estimate within 15 % (three times its error) of the exact count, and all else as counted?"""
    lines = _table(spark, sf_dir, "lineitem")
    exact, rough = ss.profile(lines).alias("e"), ss.profile(lines, approx=True).alias("r")
    off = F.abs(F.col("r.distinct_values") - F.col("e.distinct_values"))
    others = ["type", "has_missing", "max_width"]
    same = F.struct(*[F.col(f"e.{c}") for c in others]) == F.struct(*[F.col(f"r.{c}") for c in others])
    return exact.join(rough, F.col("e.column") == F.col("r.column")).select(
        F.col("e.column").alias("column"),
        (off <= 0.15 * F.col("e.distinct_values")).alias("close"),
        same.alias("same_otherwise"),
    )


@_query("""
SELECT 'vec_id' AS "column", 'bigint' AS type, count(DISTINCT vec_id) AS distinct_values, FALSE AS has_missing,
       greatest(max(length(vec_id::VARCHAR)), 6) AS max_width FROM embeddings
UNION ALL SELECT 'embedding', 'array<float>', count(DISTINCT embedding), FALSE, -1 FROM embeddings
UNION ALL SELECT 'label', 'int', count(DISTINCT label), FALSE, 5 FROM embeddings""")
def profile_nested(spark, sf_dir):
    """Nested values are counted; how wide they are shown depends on the spelling of their numbers."""
    found = ss.profile(_table(spark, sf_dir, "embeddings"))
    width = F.when(F.col("column") == "embedding", F.lit(-1)).otherwise(F.col("max_width"))
    return found.withColumn("max_width", width.cast("bigint"))


@_query("SELECT count(*) AS n FROM lineitem")
def count_rows(spark, sf_dir):
    """The count, as a table."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.agg(F.first(F.lit(ss.count_rows(lines))).alias("n"))


@_query("SELECT r_regionkey, r_name, r_name AS r_name_1 FROM region")
def unique_name(spark, sf_dir):
    """A name that is taken gets a number."""
    region = _table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return region.withColumn(first_free_name(region, "r_name"), F.col("r_name"))


@_query("""
SELECT 'o_orderpriority_part1, o_orderpriority_part2' AS added_columns, 'o_orderpriority' AS removed_columns,
       count(*) AS rows_before, count(DISTINCT o_custkey) AS rows_after,
       count(*) - count(DISTINCT o_custkey) AS rows_removed
FROM orders""")
def diff_summary(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    after = ss.remove_duplicates(orders, "o_custkey", order_by="o_orderkey")
    return ss.diff_summary(orders, ss.split_delimiter(after, "o_orderpriority", "-", n_parts=2))


def _two_versions(spark, sf_dir):
    """Orders, and orders with some cells changed, emptied or filled, rows removed and rows added."""
    orders = _table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    before = orders.where(key % 11 != 0).withColumn("o_orderstatus", F.when(key % 13 != 0, F.col("o_orderstatus")))
    after = ss.fill_missing(before.unionAll(orders.where(key % 11 == 0)).where(key % 7 != 0), "o_orderstatus", "none")
    after = ss.find_replace(after, "o_orderpriority", "1-URGENT", "NOW")
    after = after.withColumn("o_totalprice", F.when(key % 5 == 0, F.lit(0.5)).otherwise(F.col("o_totalprice")))
    return before, after


_SQL_VERSIONS = """
WITH versions AS (
  SELECT o_orderkey, o_orderkey % 11 <> 0 AS old, o_orderkey % 7 <> 0 AS new,
         CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS status, o_orderpriority AS priority, o_totalprice AS price
  FROM orders),
cells AS (
  SELECT o_orderkey, NULL AS "column", CASE WHEN new THEN 'added' ELSE 'removed' END AS change,
         NULL AS before, NULL AS after FROM versions WHERE old <> new
  UNION ALL SELECT o_orderkey, 'o_orderstatus', 'changed', NULL, 'none' FROM versions WHERE old AND new AND status IS NULL
  UNION ALL SELECT o_orderkey, 'o_orderpriority', 'changed', priority, replace(priority, '1-URGENT', 'NOW')
  FROM versions WHERE old AND new AND contains(priority, '1-URGENT')
  UNION ALL SELECT o_orderkey, 'o_totalprice', 'changed', price::VARCHAR, '0.5'
  FROM versions WHERE old AND new AND o_orderkey % 5 = 0 AND price <> 0.5)
"""


@_query(_SQL_VERSIONS + "SELECT * FROM cells")
def cell_diff(spark, sf_dir):
    """Changed, emptied and filled cells, added and removed rows."""
    return ss.cell_diff(*_two_versions(spark, sf_dir), "o_orderkey")


@_query(_SQL_VERSIONS + 'SELECT "column", change, count(*) AS cells FROM cells GROUP BY 1, 2')
def changed_cells(spark, sf_dir):
    return ss.changed_cells(*_two_versions(spark, sf_dir), "o_orderkey")


def _sql_merged(column: str, dtype: str, width: str) -> str:
    return f"""SELECT '{column}' AS "column", '{dtype}' AS type, count(*) AS rows, count(*) - count({column}) AS missing,
 greatest({width}, {len(column)}) AS max_width,
 count(DISTINCT {column}) + max(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS distinct_values, TRUE AS about FROM events"""


@_query("\nUNION ALL ".join(
    _sql_merged(c, t, w)
    for c, t, w in (
        ("event_id", "bigint", "max(length(event_id::VARCHAR))"),
        ("user_id", "bigint", "max(length(user_id::VARCHAR))"),
        ("event_type", "string", "max(length(event_type))"),
        ("props", "string", "max(length(props))"),
    )
))
def profile_merged(spark, sf_dir):
    """Events profiled day by day; the days' stored states merged, beside the exact count of all at once."""
    events = _table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    cols = ["event_id", "user_id", "event_type", "props"]
    path = _new_folder(spark)
    ss.profile_state(events, cols, by="day").write.parquet(path)
    days = spark.read.parquet(path)
    merged, exact = ss.merged_profile(days), ss.profile(events, cols).select("column", F.col("distinct_values").alias("exact"))
    off = F.abs(F.col("distinct_values") - F.col("exact"))
    return merged.join(exact, "column").select(
        "column", "type", "rows", "missing", "max_width", F.col("exact").alias("distinct_values"),
        (off <= 0.08 * F.col("exact")).alias("about"),
    )


# ---------------------------------------------------------------- recipes

_FLAGSHIP = ss.Recipe(
    [
        {"key": "op_trim", "column": "o_orderpriority"},
        {"key": "op_upper", "column": "o_orderpriority"},
        {"key": "op_split_delimiter", "column": "o_orderpriority", "delimiter": "-", "n_parts": 2},
        {"key": "op_round_numbers", "column": "o_totalprice", "decimals": 0},
        {"key": "op_remove_duplicates", "column": "o_custkey", "order_by": "o_orderkey"},
        {"key": "op_mask", "column": "o_custkey"},
    ]
)


@_query(f"""
SELECT o_orderkey, {_sql_mask('o_custkey::VARCHAR')} AS o_custkey, o_orderstatus,
       round_even(o_totalprice, 0) AS o_totalprice, o_orderdate::VARCHAR AS o_orderdate,
       split_part(upper(trim(o_orderpriority)), '-', 1) AS o_orderpriority_part1,
       split_part(upper(trim(o_orderpriority)), '-', 2) AS o_orderpriority_part2
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def recipe_flagship(spark, sf_dir):
    cleaned = _FLAGSHIP.apply(_table(spark, sf_dir, "orders"))
    return cleaned.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


CELL_RECIPE = ss.Recipe(
    [
        {"key": "op_trim", "column": "l_returnflag"},
        {"key": "op_lower", "column": "l_linestatus"},
        {"key": "op_round_numbers", "column": "l_extendedprice", "decimals": 1},
        {"key": "op_calculate_column_constant", "column": "l_tax", "operation": "*", "constant_value": 100},
        {"key": "op_mask", "column": "l_partkey"},
        {"key": "op_concatenate", "cols_to_concat": ["l_orderkey", "l_linenumber"], "separator": "-",
         "new_col_name": "line"},
        {"key": "op_find_replace", "column": "line", "find_text": "-", "replace_text": "/"},
        {"key": "op_fill_missing", "column": "l_quantity", "fill_value": "0"},
        {"key": "op_extract_pattern", "column": "line", "pattern": "(\\d)/", "new_col_name": "last_digit"},
        {"key": "op_create_calculated_column", "column": "l_extendedprice", "col2_name": "l_quantity",
         "operation": "/", "new_col_name": "unit_price", "decimals": 2},
    ]
)


@_query(f"""
SELECT l_orderkey, {_sql_mask('l_partkey::VARCHAR')} AS l_partkey, l_suppkey, l_linenumber, l_quantity,
       round_even(l_extendedprice * 10, 0) / 10 AS l_extendedprice, l_discount, l_tax * 100.0::DOUBLE AS l_tax,
       l_returnflag, lower(l_linestatus) AS l_linestatus, l_shipdate::VARCHAR AS l_shipdate,
       l_orderkey || '/' || l_linenumber AS line,
       right(l_orderkey::VARCHAR, 1) AS last_digit,
       round_even(round_even(l_extendedprice * 10, 0) / 10 / l_quantity * 100, 0) / 100 AS unit_price
FROM lineitem""")
def recipe_cells(spark, sf_dir):
    cleaned = CELL_RECIPE.apply(_table(spark, sf_dir, "lineitem"))
    return cleaned.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@_query(
    _sql_verdict(
        "c_custkey",
        "email",
        _ADDRESS,
        _SQL_EMAIL
        + r"""
 WHEN email LIKE '%@gmail.com' THEN 'Valid Common Domain'
 WHEN split_part(email, '@', 2) IN ('dept.uni3.edu', 'home.com') THEN 'Blocked Domain'
 WHEN split_part(email, '@', 2) IN (SELECT 'dept.uni' || n_nationkey || '.edu' FROM nation) THEN 'Allowed Domain'
 WHEN email LIKE '%.edu' THEN 'Valid Educational Institution'
 WHEN email LIKE '%.com' THEN 'Valid Commercial'
 WHEN email LIKE '%.co.uk' THEN 'Valid Domain' ELSE 'Unknown TLD'""",
        "customer",
    )
)
def recipe_email_lists(spark, sf_dir):
    """Block and suffix lists inside the recipe, the allow list in a file, saved as JSON and read back."""
    path = _new_folder(spark)
    nation = _table(spark, sf_dir, "nation")
    nation.select(F.concat(F.lit("dept.uni"), "n_nationkey", F.lit(".edu")).alias("value")).write.text(path)
    check = {"key": "op_validate_email", "column": "email", "allowed": path}
    check |= {"blocked": ["dept.uni3.edu", "home.com"], "suffixes": ["com", "co.uk"]}
    recipe = ss.Recipe.from_json(ss.Recipe([check]).to_json())
    return recipe.apply(_addresses(spark, sf_dir))


@_query("""
WITH few AS (SELECT c_custkey, upper(c_name) AS c_name FROM customer ORDER BY c_custkey LIMIT 1000)
SELECT c_custkey, 'before' AS half, c_name, NULL::BOOLEAN AS c_name__modified FROM few
UNION ALL SELECT c_custkey, 'after', replace(c_name, '#', ''), contains(c_name, '#') FROM few""")
def preview(spark, sf_dir):
    """Both halves of a preview."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", F.upper("c_name").alias("c_name"))
    operation = {"key": "op_remove_specific", "column": "c_name", "chars_to_remove": "#"}
    before, after = ss.preview(customer, operation, order_by="c_custkey")
    before = before.select("c_custkey", F.lit("before").alias("half"), "c_name", F.lit(None).cast("boolean").alias("c_name__modified"))
    return before.unionAll(after.select("c_custkey", F.lit("after"), "c_name", "c_name__modified"))


# ---------------------------------------------------------------- sources, sinks, streams


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Written as CSV, read back with the types found from the text."""
    path = _new_folder(spark)
    ss.write_table(_table(spark, sf_dir, "customer"), path, "csv")
    return ss.read_table(spark, path, "csv")


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_quoted_text(spark, sf_dir):
    """Texts with quotes and line breaks through CSV."""
    path = _new_folder(spark)
    documents = _table(spark, sf_dir, "documents")
    ss.write_table(documents, path, "csv")
    return ss.read_table(spark, path, "csv", schema=documents.schema, missing_tokens=())


# A task writes about as much text into one file.
_CSV_FILE_BYTES = 64 << 20


@_query("SELECT doc_id, text, lang, source, n_chars, TRUE AS by_many_tasks FROM documents")
def csv_split_quotes(spark, sf_dir):
    """The same texts in one file of many small blocks (one for every 64 MB of text), cut into records by as many tasks."""
    path, setting = _new_folder(spark), "spark.sql.files.maxPartitionBytes"
    documents = _table(spark, sf_dir, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ss.write_table(documents.coalesce(1 + size // _CSV_FILE_BYTES), path, "csv")
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(64 << 10))
    try:
        blocks = QuoteCounts(spark, path).opens
        read = ss.read_table(spark, path, "csv", schema=documents.schema, missing_tokens=())
    finally:
        spark.conf.set(setting, before)
    return read.withColumn("by_many_tasks", F.lit(len(blocks) > 8))


@_query("SELECT o_orderkey, '1234567890123' || lpad(o_orderkey::VARCHAR, 12, '0') AS id FROM orders")
def csv_big_ids(spark, sf_dir):
    """Ids of 25 digits stay what they are through CSV."""
    path = _new_folder(spark)
    padded = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    ids = _table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("1234567890123"), padded).alias("id"))
    ss.write_table(ids, path, "csv")
    return ss.read_table(spark, path, "csv")


@_query("""
SELECT n_nationkey || ',"a ""b"", c",' || n_name || ',lost' AS line, 4 AS cells FROM nation WHERE n_regionkey >= 2""")
def csv_ragged_report(spark, sf_dir):
    """Lines with more cells than the header; the nations of three regions have some."""
    path = _new_folder(spark)
    end = F.when(F.col("n_regionkey") >= 2, ",lost").otherwise("")
    line = F.concat(F.col("n_nationkey").cast("string"), F.lit(',"a ""b"", c",'), "n_name", end)
    nation = _table(spark, sf_dir, "nation")
    # The one file begins with its header.
    header = nation.agg(F.lit("key,quoted,name").alias("value"))
    rows = nation.select(line.alias("value"))
    header.unionAll(rows).coalesce(1).write.text(path)
    return ss.bad_lines(spark, path).select("line", "cells")


@_query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_round_trip(spark, sf_dir):
    path = _new_folder(spark)
    documents = _table(spark, sf_dir, "documents")
    ss.write_table(documents, path, "json")
    return ss.read_table(spark, path, "json", schema=documents.schema)


_STREAM_RECIPE = ss.Recipe(
    [
        {"key": "op_upper", "column": "event_type"},
        {"key": "op_remove_non_numeric", "column": "props"},
        {"key": "op_round_numbers", "column": "value", "decimals": 1},
        {"key": "op_validate_numeric", "column": "props"},
    ]
)


def _drain(stream: DataFrame) -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    spark = stream.sparkSession
    path, state = _new_folder(spark), _new_folder(spark)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _event_stream(spark, sf_dir):
    schema = _table(spark, sf_dir, "events").schema
    return read_stream(spark, sf_dir, "parquet", schema, pattern="events.parquet")


@_query("""
SELECT event_id, ts::VARCHAR AS ts, user_id, event_type, value, props, reason <> 'Valid' AS props__invalid,
       reason AS props__reason
FROM (SELECT *, CASE WHEN props IS NULL OR props = '' THEN 'Empty'
                     WHEN regexp_full_match(props, '-?[0-9]+([.][0-9]*)?') THEN 'Valid' ELSE 'Invalid Format' END AS reason
      FROM (SELECT event_id, ts, user_id, upper(event_type) AS event_type, round_even(value * 10, 0) / 10 AS value,
                   coalesce(regexp_replace(props, '[^0-9.-]', '', 'g'), '') AS props FROM events))""")
def stream_recipe(spark, sf_dir):
    cleaned = apply_recipe(_event_stream(spark, sf_dir), _STREAM_RECIPE)
    return _drain(cleaned.withColumn("ts", F.col("ts").cast("string")))


@_query("""
SELECT user_id, event_type, TRUE AS is_a_row, count(*) AS rows_of_it
FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2""")
def stream_drop_duplicates(spark, sf_dir):
    """The span is longer than the table, so one row per user and type arrives first: which one depends on the
    order of arrival, but it is a row of the table, with its own id, time and value."""
    stream = drop_duplicates(
        _event_stream(spark, sf_dir), ["user_id", "event_type"], event_time="ts", within="3650 days"
    )
    found, events = _drain(stream), _table(spark, sf_dir, "events")
    cells = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    same = [found[c].eqNullSafe(events[c]) for c in cells]
    joined = found.join(events, same[0] & same[1] & same[2] & same[3] & same[4] & same[5], "left")
    hit = events["event_id"].isNotNull()
    return joined.groupBy(found["user_id"], found["event_type"]).agg(
        F.bool_and(hit).alias("is_a_row"), F.count(F.lit(1)).alias("rows_of_it")
    )


@_query("""
WITH starts AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1
            END AS opens FROM events),
runs AS (
  SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY ts, opens DESC ROWS UNBOUNDED PRECEDING) AS run
  FROM starts),
placed AS (
  SELECT *, max(ts) OVER (PARTITION BY user_id, event_type, run) AS last_ts,
         row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY value NULLS FIRST, event_id) AS place FROM runs)
SELECT event_id, user_id, event_type, value, props FROM placed
WHERE place = 1 AND last_ts + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 DAY""")
def stream_first_by_order(spark, sf_dir):
    """The row with the least value of each user, type and run of events less than a day apart, once the run is over."""
    stream = first_by_order(
        _event_stream(spark, sf_dir), ["user_id", "event_type"], ["value", "event_id"], event_time="ts", within="1 day"
    )
    return _drain(stream).select("event_id", "user_id", "event_type", "value", "props")


@_query("""
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN c_mktsegment IN ('NA', '') THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM (SELECT c_custkey, c_name, c_nationkey, c_acctbal,
             CASE WHEN c_mktsegment = 'BUILDING' THEN 'NA' ELSE c_mktsegment END AS c_mktsegment FROM customer)""")
def stream_csv(spark, sf_dir):
    """CSV as a stream: missing tokens and number spellings as in batch."""
    path = _new_folder(spark)
    customer = _table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_mktsegment"))
    ss.write_table(customer.withColumn("c_mktsegment", segment), path, "csv")
    return _drain(read_stream(spark, path, "csv", customer.schema))


# ---------------------------------------------------------------- the contract


def entry(spark: SparkSession) -> DataFrame:
    """Orders cleaned by a recipe that keeps the first order of each customer."""
    use_own_folder(spark)
    return recipe_flagship(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator: ``(spark, sf_dir) -> DataFrame``."""

    def ready(run):
        def with_folder(spark, sf_dir):
            use_own_folder(spark)
            return run(spark, sf_dir)

        return with_folder

    found = {name: ready(run) for name, run in _QUERIES.items()}
    if _corpus is not None:
        found |= _corpus.QUERIES
    if _pipeline is not None:
        found["pipeline"] = _pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    """The same results in SQL, by query name."""
    found = dict(_SQL)
    if _corpus is not None:
        found |= _corpus.SQL
    if _pipeline is not None and _pipeline.ORACLE_SQL is not None:
        found["pipeline"] = _pipeline.ORACLE_SQL
    return found
