import random
import re
from collections import Counter

from pyspark.sql import functions as F

from usagelens.catalog import projections as p
from usagelens.config import RuleConfig
from usagelens.functions.text import collapse_whitespace
from usagelens.operators import rules as r
from usagelens.plans.jobs import Store, ensure_rule_scan, run_rule_scan


def company(spark):
    customers = spark.createDataFrame([
        ("c1", "CST-2001", "Northwind Retail GmbH", "Emma Clark", "emma.clark@northstar-industries.com", "enterprise", "420000.00"),
        ("c2", "CST-2002", "Müller & Söhne", "Liam Nguyen", "l.n@x.com", "mid-market", "185000.00"),
        ("c3", "7", "東京", "A", "a+b=c", "C++", "99.50"), ("c4", "", None, " ", "-", "\\E[x]", None)],
        "id string, customer_code string, company_name string, contact_name string, email string, segment string, v string")
    customers = customers.selectExpr("* EXCEPT (v)", "CAST(v AS DECIMAL(12,2)) AS annual_contract_value_eur")
    documents = spark.createDataFrame([(
        "d1", "Q1 2026 Financial Summary", "ERP", "postgres", "Revenue: EUR 12.4M, COGS: EUR 7.1M, Gross Margin: 42.7%.",
        '{"department":"Finance","x":[1,true,null,{"deep":"v"}],"fiscal":2026}')],
        "id string, title string, source string, source_type string, content_preview string, metadata_json string")
    return {"customers": customers, "documents": documents}


def as_python(pattern):
    return re.compile(re.sub(r"\\Q(.*?)\\E(?!\\\\)", lambda m: re.escape(m.group(1)), pattern, flags=re.S), re.I)


def brute_force(rules, texts):
    out = []
    for rule in rules:
        if "\\E\\\\E" in rule["pattern"]:
            compiled = re.compile(r"\b" + re.escape(rule["value"].strip()) + r"\b", re.I)
        else:
            compiled = as_python(rule["pattern"])
        for key, text in texts.items():
            out += [(key, rule["rule_id"], m.start(), m.group(0)) for m in compiled.finditer(text)]
    return sorted(out)


def test_scan_equals_brute_force(spark):
    rules = r.build_all_rules(company(spark)).cache()
    listed = rules.collect()
    random.seed(1)
    words = ("the emma clark mueller EmmaClark Emma-Clark, 4,2,0,0,0,0 420.000 CST2001 CST 2001 c++ x 7 77 東京 東京x a A müller "
             "söhne Müller_Söhne 2026 Q1-2026 financial summary").split()
    values = [x["value"] for x in listed]
    made = []
    for i in range(300):
        parts = [random.choice(words) if random.random() < .6 else random.choice(values) for _ in range(random.randint(1, 15))]
        made.append((i, random.choice([" ", "  ", "", "-"]).join(w.upper() if random.random() < .1 else w for w in parts)))
    messages = spark.createDataFrame(made, "id int, t string").repartition(4)
    texts = {x["id"]: x["n"] for x in messages.select("id", collapse_whitespace(F.col("t")).alias("n")).collect()}
    want = brute_force(listed, texts)
    assert len(want) > 1000
    found = r.scan_messages(messages, rules, ["id"], "t")
    assert sorted(tuple(x) for x in found.select("id", "company_rule_id", "start", "matched_text").collect()) == want


def test_rules_of_whole_tables_equal_brute_force(spark, folder):
    rules = r.build_all_rules(p.company_tables(spark, folder)).cache()
    messages = p.chats(spark, folder).select("message_id", "user_text_clean").cache()
    texts = {x["message_id"]: x["user_text_clean"] for x in messages.collect()}
    want = brute_force([x for x in rules.collect() if x["source_table"] == "customers"], texts)
    found = r.scan_messages(messages, rules.filter("source_table = 'customers'"), ["message_id"])
    assert sorted(tuple(x) for x in found.select("message_id", "company_rule_id", "start", "matched_text").collect()) == want
    assert want


def test_rule_build(spark):
    rules = {x["rule_id"]: x for x in r.build_all_rules(company(spark)).collect()}
    assert rules["customers:c1:email"]["severity"] == "critical" and rules["customers:c1:email"]["category"] == "pii"
    assert rules["customers:c1:segment"]["severity"] == "medium"
    assert rules["documents:d1:source_type"]["severity"] == "low"
    assert rules["customers:c1:annual_contract_value_eur"]["value"] == "420000.00"
    scalars = [rules[f"documents:d1:metadata_json:{i}"] for i in range(9)]
    assert sorted(x["value"] for x in scalars) == sorted(["department", "Finance", "x", "1", "True", "deep", "v", "fiscal", "2026"])
    assert rules["documents:d1:metadata_json:0"]["label"] == "documents.metadata_json[0]"
    assert not any(k.startswith("customers:c4:customer_code") or k.startswith("customers:c4:contact") for k in rules)
    old = {x["rule_id"]: x["pattern"] for x in r.build_all_rules(company(spark), legacy_separators=True).collect()}
    assert old["customers:c1:email"] == r"\bemma[\s\-_./]*clark[\s\-_./]*northstar[\s\-_./]*industries[\s\-_./]*com\b"


def test_json_that_is_no_json(spark):
    got = spark.createDataFrame([("plain words",), ('{"a": {"b": {"c": [1, "d"]}}}',), (None,)], "x string").select(
        r.json_scalars(F.col("x")).alias("v")).collect()
    assert got[0]["v"] == ["plain words"] and got[1]["v"] == ["a", "b", "c", "1", "d"]


def test_rule_run_is_repeatable(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    chats = spark.createDataFrame([
        ("f", "k1", None, "chatgpt", "gpt-4", "m1", "user", "user", "Budget for Emma Clark, EMMA CLARK and emma clark"),
        ("f", "k1", None, "chatgpt", "gpt-4", "m2", "user", "user", "code CST 2001"),
        ("f", "k2", "Ticket", "gemini", None, "m3", "user", "user", "nothing")],
        "source_file string, conversation_key string, conversation_title string, provider string, model_name string, "
        "message_id string, author string, role string, user_text_clean string").withColumn(
        "message_timestamp", F.lit("2026-01-01 10:00:00").cast("timestamp"))
    rules = r.build_all_rules(company(spark))
    as_of = F.lit("2026-01-02 00:00:00").cast("timestamp")
    views = run_rule_scan(store, chats, rules, "r1", as_of)
    first = sorted(tuple(x) for x in store.table("company_matches").read().select("message_id", "matched_text", "department").collect())
    # Equal text in one message is one row; another spelling is another row.
    assert first == [("m1", "EMMA CLARK", "finance"), ("m1", "Emma Clark", "finance"), ("m1", "emma clark", "finance"),
                     ("m2", "CST 2001", "engineering")]
    assert views["match_conversations"].first()["match_count"] == 4
    stats = {x["rule_id"]: x["match_count"] for x in views["rule_stats"].collect()}
    assert stats["customers:c1:contact_name"] == 3 and stats["customers:c2:email"] == 0
    summary = store.table("conversation_summaries").read().first()
    assert (summary["department"], summary["pii_count"], summary["secret_count"], summary["highest_severity"]) == ("finance", 3, 1, "high")
    run_rule_scan(store, chats, rules, "r1", as_of)
    assert store.table("company_matches").read().count() == 4 and store.table("analysis_runs").read().count() == 1
    assert ensure_rule_scan(store, chats, rules, "r2", as_of) is None


def test_no_rules(spark):
    messages = spark.createDataFrame([(1, "x")], "id int, t string")
    rules = r.build_all_rules(company(spark)).limit(0)
    assert r.scan_messages(messages, rules, ["id"], "t").count() == 0


def test_rule_configuration(tmp_path):
    from usagelens.config import RuleConfig

    (tmp_path / "rules.json").write_text('{"category_rules": {"by_table": {"t": "secret"}, "by_field": {"mail": "pii"}}, '
                                         '"severity_rules": {"by_field": {"mail": "critical"}, "by_table_field": {"t": {"a": "high"}}}, '
                                         '"department_keywords": {"x": ["y"]}}')
    made = RuleConfig.from_file(str(tmp_path / "rules.json"))
    assert (made.category("t", "a"), made.category("t", "mail"), made.category("u", "a")) == ("secret", "pii", "secret")
    assert (made.severity("t", "a"), made.severity("t", "mail"), made.severity("t", "b")) == ("high", "critical", "medium")
    assert made.department_keywords == {"x": ["y"]}


def test_case_partners_blanks_and_shared_values(spark):
    rows = spark.createDataFrame([("1", "customer 5"), ("2", "kilo"), ("3", "\u00a0lead"), ("4", "k\u0131lo"), ("5", "\u6771\u4eac"), ("6", "\u03c3\u03bf\u03c6\u03cc\u03c2"),
                                  ("7", "x"), ("8", "kilo"), ("9", "a b")], "id string, company_name string")
    rules = r.build_rules("customers", rows, RuleConfig(table_fields={"customers": {"company_name": "high"}}))
    texts = ["a cu\u017ftomer 5 b", "k\u0131lo", "\u212aILO", "my lead", "in \u6771\u4eac now", "\u03a3\u039f\u03a6\u038c\u03a3 x", "X-ray a-B", "K\u0130LO kilo"]
    messages = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = Counter((x.id, x.company_rule_id.split(":")[1]) for x in r.scan_messages(messages, rules, ["id"], "t").collect())
    listed = {x.rule_id.split(":")[1]: x.pattern for x in rules.collect()}
    want = Counter()
    for n, text in enumerate(texts):
        for rule, pattern in listed.items():
            hits = spark.range(1).select(F.size(F.regexp_extract_all(F.lit(text), F.lit("(?iU)" + pattern), F.lit(0))).alias("n")).first().n
            if hits:
                want[n, rule] = hits
    assert got == want and {(0, "1"), (3, "3"), (4, "5"), (1, "2"), (1, "8")} <= set(got)


def test_json_cells_keep_the_order_of_the_text(spark):
    deep = "[" * 40 + '{"z": true, "a": {"b": [null, 1.5, "x"]}}' + "]" * 40
    got = spark.createDataFrame([(deep,), ("",), ("{bad",)], "x string").select(r.json_scalars(F.col("x")).alias("v")).collect()
    assert [x.v for x in got] == [["z", "True", "a", "b", "1.5", "x"], [], ["{bad"]]
