"""Hand-written examples for every branch of the validators (FIXTURES.md)."""

import random
import pytest

import sparkscrub as ss


def verdict(spark, kind, value, dtype="string", **options):
    row = ss.validate(spark.createDataFrame([(value,)], f"v {dtype}"), "v", kind, **options).first()
    return not row.v__invalid, row.v__reason


EMAILS = [
    ("a@gmail.com", {}, True, "Valid Common Domain"),
    (" A@GMAIL.COM ", {}, True, "Valid Common Domain"),
    ("a@acme.com", {}, True, "Valid Commercial"),
    ("a@uni.edu", {}, True, "Valid Educational Institution"),
    ("a@uni.edu.tr", {"suffixes": ["edu.tr"]}, True, "Valid International Educational Institution"),
    ("a@x.ac.uk", {"suffixes": ["ac.uk"]}, True, "Valid Academic Institution"),
    ("a@x.gov", {}, True, "Valid Government Institution"),
    ("a@x.mil", {}, True, "Valid Military Institution"),
    ("a@x.org", {}, True, "Valid Organization"),
    ("a@x.net", {}, True, "Valid Network"),
    ("a@x.co.uk", {"suffixes": ["co.uk"]}, True, "Valid Domain"),
    ("a@x.zz", {}, False, "Unknown TLD"),
    ("a@x.de", {"suffixes": ["de"]}, True, "Valid Domain"),
    ("a@x.de", {"suffixes": ["de"], "strict_compat": True}, False, "Unknown TLD"),
    ("a@x.y.ck", {"suffixes": ["*.ck"], "strict_compat": True}, True, "Valid Domain"),
    ("a@bad.com", {"blocked": ["bad.com"]}, False, "Blocked Domain"),
    ("a@bad.com", {"blocked": ["bad.com"], "allowed": ["bad.com"]}, False, "Blocked Domain"),
    ("a@gmail.com", {"blocked": ["gmail.com"]}, True, "Valid Common Domain"),
    ("a@ok.zz", {"allowed": ["ok.zz"]}, True, "Allowed Domain"),
    ("a@-x.com", {}, False, "Invalid Format"),
    ("a..b@c.com", {}, False, "Invalid Format"),
    (".a@b.com", {}, False, "Invalid Format"),
    ("a@b", {}, False, "Invalid Format"),
    ("é@b.com", {}, True, "Valid Commercial"),
    ("x" * 64 + "@b.com", {}, True, "Valid Commercial"),
    ("x" * 65 + "@b.com", {}, False, "Invalid Format"),
]


@pytest.mark.parametrize("value, options, valid, reason", EMAILS)
def test_email(spark, value, options, valid, reason):
    assert verdict(spark, "email", value, **options) == (valid, reason)


@pytest.mark.parametrize("hot", [False, True])
def test_email_lists_as_tables(spark, hot):
    """Tables of domains give what collections give, however they are joined."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1 if hot else limit)
    try:
        df = spark.createDataFrame([(i, v) for i, (v, *_) in enumerate(EMAILS)], "i int, v string")
        lists = {"suffixes": ["co.uk", "*.ck", "de"], "blocked": ["bad.com", "gmail.com"], "allowed": ["ok.zz"]}
        tables = {k: spark.createDataFrame([(d.upper(),) for d in v], "domain string") for k, v in lists.items()}
        expected = ss.validate_email(df, "v", **lists).orderBy("i").collect()
        assert ss.validate_email(df, "v", **tables).orderBy("i").collect() == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize(
    "value, valid, reason",
    [
        ("+90 (532) 123-4567", True, "Valid"),
        ("12345", False, "Invalid Length"),
        ("1234567890123456", False, "Invalid Length"),
        ("555.123.4567", False, "Invalid Format"),
        ("1234567 ", True, "Valid"),
        ("123 4567", True, "Valid"),
        ("1 2 3 4 5 6 7 8 9 0 1 2", False, "Invalid Format"),
    ],
)
def test_phone(spark, value, valid, reason):
    assert verdict(spark, "phone", value) == (valid, reason)


@pytest.mark.parametrize(
    "value, valid",
    [
        ("2024-01-31", True), ("31/01/2024", True), ("1/31/2024", True), ("31.1.2024", True),
        ("2024-01-31 10:20:30", True), ("2024-01-31T10:20:30.123Z", True), ("20240131", True),
        ("Jan 31 2024", True), ("31 January 2024", True), ("March 5, 2024", True), ("31/01/24", True),
        ("1/31/2024 9:05 PM", True), ("2024-02-29", True),
        ("2024-13-45", False), ("x", False), ("2023-02-29", False), ("31/31/2024", False),
        ("2024-01-31 25:00", False), ("999999999999999999999999999999", False), ("Foo 31 2024", False),
    ],
)
def test_date(spark, value, valid):
    assert verdict(spark, "date", value) == (valid, "Valid" if valid else "Invalid Format")


def test_date_formats(spark):
    assert verdict(spark, "date", "31|01|2024", formats=["dd|MM|yyyy"]) == (True, "Valid")
    assert verdict(spark, "date", "2024-01-31", formats=["dd|MM|yyyy"]) == (False, "Invalid Format")
    assert verdict(spark, "date", "2024-01-31T10:00:00", formats=["yyyy-MM-dd'T'HH:mm:ss"]) == (True, "Valid")


@pytest.mark.parametrize(
    "value, valid",
    [("1e5", True), ("1_000", True), ("inf", True), (".5", True), ("-1.", True), (" 1 ", True), ("NaN", True),
     ("١٢", True), ("0x1A", False), ("1__0", False), (".", False), ("_1", False), ("1_", False), ("1e", False),
     ("1d", False)],
)
def test_numeric(spark, value, valid):
    assert verdict(spark, "numeric", value) == (valid, "Valid" if valid else "Invalid Format")


def test_numeric_types(spark):
    assert verdict(spark, "numeric", 1.5, "double") == (True, "Valid")
    assert verdict(spark, "numeric", float("nan"), "double") == (False, "Empty")
    assert verdict(spark, "numeric", False, "boolean") == (True, "Valid")
    assert verdict(spark, "numeric", None, "int") == (False, "Empty")


def test_letters(spark):
    assert verdict(spark, "alphanumeric", "Ça va") == (True, "Valid")
    assert verdict(spark, "alphanumeric", "a1") == (False, "Invalid Character")
    assert verdict(spark, "alphanumeric", "a1", allow_digits=True) == (True, "Valid")


@pytest.mark.parametrize(
    "value, valid",
    [("HTTP://x", True), ("https://a/b", True), ("https:x", False), ("http:///a", False), ("ftp://a", False),
     ("ht\ntp://x", True), ("http://?q", False), ("see http://x", False)],
)
def test_url(spark, value, valid):
    assert verdict(spark, "url", value) == (valid, "Valid" if valid else "Invalid Format")


@pytest.mark.parametrize("kind", ["email", "phone", "date", "numeric", "alphanumeric", "url"])
def test_empty_and_header(spark, kind):
    for value in (None, "", " ", " "):
        assert verdict(spark, kind, value) == (False, "Empty")
    assert verdict(spark, kind, "v") == (False, "Column Header")


def test_column_becomes_text(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "v double")
    assert [r.v for r in ss.validate_numeric(df, "v").collect()] == ["1.0", ""]
    assert [r.v for r in ss.validate_numeric(df, "v", as_text=False).collect()] == [1.0, None]


def test_bare_address_check(spark):
    df = spark.createDataFrame([("a@gmail.com",), ("v",), ("",), (None,), ("a@b",)], "v string")
    reasons = [r.v__reason for r in ss.check_email_address(df, "v").collect()]
    assert reasons == ["Valid Common Domain"] + ["Invalid Email Format"] * 4


def test_second_check_keeps_the_first_failure(spark):
    df = spark.createDataFrame([("abc",), ("1234567",), ("a1",)], "v string")
    both = ss.validate_alphanumeric(ss.validate_phone(df, "v"), "v").collect()
    assert [(r.v__invalid, r.v__reason) for r in both] == [
        (True, "Invalid Length"), (True, "Invalid Character"), (True, "Invalid Character"),
    ]


def test_unknown_kind(spark):
    with pytest.raises(ValueError, match="unknown kind"):
        verdict(spark, "iban", "x")


def test_rules_edit():
    rules = ss.DomainRules().block("Bad.com").allow("ok.zz")
    assert rules.to_dict() == {"allowed": ["ok.zz"], "blocked": ["bad.com"]}
    assert rules.allow("bad.com").to_dict() == {"allowed": ["bad.com", "ok.zz"], "blocked": []}
    assert rules.without("OK.zz").to_dict() == {"allowed": [], "blocked": ["bad.com"]}
    assert ss.DomainRules.from_dict(rules.to_dict()) == rules


def test_summary(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), ("", "c")], "v string, w string")
    df = ss.validate_alphanumeric(ss.validate_numeric(df, "v"), "w")
    rows = {r["column"]: (r.valid, r.total, round(r.rate, 1)) for r in ss.validation_summary(df).collect()}
    assert rows == {"v": (1, 3, 33.3), "w": (3, 3, 100.0)}
    counts = {(r["column"], r.reason): r.cells for r in ss.reason_counts(df).collect()}
    assert counts == {("v", "Valid"): 1, ("v", "Invalid Format"): 1, ("v", "Empty"): 1, ("w", "Valid"): 3}
    empty = ss.validation_summary(df.where("false")).first()
    assert (empty.total, empty.rate) == (0, 0.0)


def test_counts_of_marked_cells(spark):
    df = spark.createDataFrame([("a ", "x"), ("b", "x"), ("c", None)], "v string, w string")
    df = ss.mark_duplicates(ss.trim(df, "v", flags=True), ["w"])
    rows = {r["column"]: (r.valid, r.duplicates, r.modified) for r in ss.validation_summary(df).collect()}
    assert rows == {"v": (None, None, 1), "w": (None, 2, None)}


def _jobs(spark, build):
    """Jobs that building a DataFrame runs."""
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("counted", "counted")
    df = build()
    jobs = len(tracker.getJobIdsForGroup("counted"))
    context.setLocalProperty("spark.jobGroup.id", None)
    return df, jobs


def test_small_lists_cost_nothing_but_their_own_measure(spark):
    df = spark.range(600).selectExpr("id", "concat('a@h', id % 40, '.zz') AS v")
    blocked = spark.createDataFrame([("H3.zz ",), ("h4.zz",), (None,), ("h3.zz",)], "d string")
    suffixes = spark.createDataFrame([("*.zz",)], "d string")
    out, jobs = _jobs(spark, lambda: ss.validate_email(df, "v", blocked=blocked, suffixes=suffixes))
    assert jobs <= 8  # writing and measuring each list; nothing of the data
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in text
    found = {r.v__reason: r["count"] for r in out.groupBy("v__reason").count().collect()}
    assert found == {"Blocked Domain": 30, "Valid Domain": 570}


def test_large_lists_meet_the_distinct_domains(spark):
    """A domain that fills the table is spread by a salt although no list names it."""
    from pyspark.sql import functions as F

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        host = F.when(F.col("id") % 3 > 0, "big.com").otherwise(F.concat(F.lit("h"), F.col("id") % 40, F.lit(".com")))
        df = spark.range(600).select("id", F.concat(F.lit("a@"), host).alias("v"))
        blocked = spark.range(600).select(F.concat(F.lit("h"), "id", F.lit(".com")).alias("d")).where("id < 10")
        out = ss.validate_email(df, "v", blocked=blocked)
        assert "big.com" in out._jdf.queryExecution().optimizedPlan().toString(), "the common domain is known"
        found = {r.v__reason: r.n for r in out.groupBy("v__reason").agg(F.count(F.lit(1)).alias("n")).collect()}
        expected = sum(1 for i in range(600) if i % 3 == 0 and i % 40 < 10)
        assert found == {"Blocked Domain": expected, "Valid Commercial": 600 - expected}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize(
    "text",
    ["31st January 2024", "Jan. 31, 2024", "2024-01", "10 Sep, 2024", "Sept 3 2024", "Wed, 31 Jan 2024 10:00:00",
     "Wednesday 31 January 2024", "Sept. 2, 2024", "2nd May 2020"],
)
def test_written_dates(spark, text):
    assert verdict(spark, "date", text) == (False, "Valid") or verdict(spark, "date", text)[1] == "Valid"


@pytest.mark.parametrize("text", ["31th2024", "Jan. 2024 31 1", "st January", "Wed", "2024-13", "32nd May 2020"])
def test_no_dates(spark, text):
    assert verdict(spark, "date", text)[1] == "Invalid Format"


@pytest.mark.parametrize(
    "domain, reason",
    [
        ("a.edu", "Valid Educational Institution"), ("a.edu.au", "Valid International Educational Institution"),
        ("a.ac.uk", "Valid Academic Institution"), ("a.gov", "Valid Government Institution"),
        ("a.gov.uk", "Valid International Government Institution"), ("a.mil", "Valid Military Institution"),
        ("a.org", "Valid Organization"), ("a.com", "Valid Commercial"), ("a.net", "Valid Network"),
        ("edu.uk", "Valid Domain"), ("a.mil.uk", "Valid Domain"), ("a.edu.u2", "Unknown TLD"), ("ac.uk", "Valid Domain"),
    ],
)
def test_kinds_of_owner(spark, domain, reason):
    email = "x@" + domain
    found = verdict(spark, "email", email, suffixes=("*.uk", "*.au"))[1]
    assert found == ("Invalid Format" if domain.endswith("2") else reason)


def test_suffix_list_from_a_file(spark, tmp_path):
    (tmp_path / "list.txt").write_text("// a comment\n\nco.uk\n *.ck \n")
    suffixes = ss.read_domain_list(spark, str(tmp_path / "list.txt"))
    assert sorted(r.domain for r in suffixes.collect()) == ["*.ck", "co.uk"]
    assert verdict(spark, "email", "a@x.co.uk", suffixes=suffixes) == (True, "Valid Domain")


_SUFFIX_RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "aa.bb.cc.dd", "*.bb.cc.dd.ee", " JP "]


def _known(domain, rules):
    """The longest rule that fits, exceptions first, label by label."""
    labels, best = domain.split("."), None
    for rule in (r.strip().lower() for r in rules):
        exception, parts = rule.startswith("!"), rule.lstrip("!").split(".")
        tail = labels[-len(parts) :]
        if len(tail) == len(parts) and all(p in ("*", t) for p, t in zip(parts, tail, strict=True)):
            best = max(best or (False, 0), (exception, len(parts) - exception))
    return best is not None and len(labels) > best[1]


@pytest.mark.parametrize("as_table, limit", [(False, None), (True, None), (True, "-1")])
def test_suffix_rules_of_any_depth(spark, as_table, limit):
    rng = random.Random(1)
    names = ["aa", "bb", "cc", "dd", "ee", "ck", "www", "kobe", "city", "jp", "uk", "co", "com"]
    domains = {".".join(rng.choice(names) for _ in range(rng.randint(2, 6))) for _ in range(400)}
    domains |= {"x.com", "com.com", "x.y.www.ck", "b.ck", "x.aa.bb.cc.dd", "bb.cc.dd", "q.bb.cc.dd.ee", "x.q.bb.cc.dd.ee"}
    rules = spark.createDataFrame([(r,) for r in _SUFFIX_RULES], "rule string") if as_table else _SUFFIX_RULES
    df = spark.createDataFrame([(f"me@{d}",) for d in sorted(domains) * 3], "email string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        rows = ss.validate_email(df, "email", suffix_rules=rules).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(rows) == 3 * len(domains)
    for r in rows:
        assert (r["email__reason"] == "Unknown TLD") != _known(r["email"][3:], _SUFFIX_RULES), r


def test_suffix_rules_in_recipes_and_copies(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("// rules\n*.ck\n!www.ck\n")
    df = spark.createDataFrame([("a@www.ck",), ("a@b.ck",), ("a@x.com",)], "email string")
    step = {"key": "op_validate_email", "column": "email", "suffix_rules": str(tmp_path / "rules.txt")}
    found = ss.Recipe([step]).apply(df).collect()
    assert [r["email__invalid"] for r in sorted(found, key=lambda r: r["email"])] == [True, False, True]
    rules = ss.DomainRules(suffix_rules=["com"]).allow("b.ck")
    assert rules.suffix_rules == ["com"]
    reasons = {r["email"]: r["email__reason"] for r in ss.validate_email(df, "email", rules=rules).collect()}
    assert reasons == {"a@www.ck": "Unknown TLD", "a@b.ck": "Allowed Domain", "a@x.com": "Valid Commercial"}
