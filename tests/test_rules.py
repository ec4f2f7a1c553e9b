"""Golden cases of validators, expressions and transformers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from colophon.functions.address import occurrences, xpath_of
from colophon.functions.expression import compile_expression
from colophon.model import QUANTIFIERS, BadRule, rule_from_json, rule_to_json, rules_from_json, schemas
from colophon.operators import fields, validators
from colophon.operators import transformers as t
from colophon.operators.validators import ContentLength, ControlledValue, FieldExpression, NodeOccurs, Regex, ValidatorRule, YearRange, validate


def record(spark, **values):
    schema = "record_id long, " + ", ".join(f"`{k}` array<string>" for k in values)
    return spark.createDataFrame([(1, *values.values())], schema)


def verdicts(spark, make, values):
    df = record(spark, f=values)
    return [df.select(make(q).verdict(lambda name: F.col(name)).alias("v")).first()["v"] for q in QUANTIFIERS]


ONLY_OK = lambda q: ControlledValue(field="f", values=["ok"], quantifier=q)


@pytest.mark.parametrize(
    ("values", "expected"),
    [([], [False, False, True, True, True]), (["x", "y"], [False, False, False, True, False]), (["ok", "x"], [True, True, True, False, False]), (["ok", "ok"], [False, True, True, False, True])],
)
def test_content_quantifiers(spark, values, expected):
    assert verdicts(spark, ONLY_OK, values) == expected


@pytest.mark.parametrize(("values", "expected"), [([], [False, False, True, True, True]), (["x"], [False, False, True, True, False]), (["ok", "x"], [True, True, True, False, False])])
def test_expression_quantifiers(spark, values, expected):
    assert verdicts(spark, lambda q: FieldExpression(expression="f=='ok'", quantifier=q), values) == expected


def test_legacy_expression_quantifier(spark):
    assert verdicts(spark, lambda q: FieldExpression(expression="f=='ok'", quantifier=q, legacy_quantifier=True), ["x"]) == [False] * 5


@pytest.mark.parametrize(("n", "expected"), [(0, [False, False, True, True, False]), (1, [True, True, True, False, True]), (2, [False, True, True, False, True])])
def test_node_quantifiers(spark, n, expected):
    df = spark.createDataFrame([("<metadata>" + "<a>v</a>" * n + "<a></a></metadata>",)], "xml string")
    assert [df.select(NodeOccurs(xpath="//a", quantifier=q).verdict(None).alias("v")).first()["v"] for q in QUANTIFIERS] == expected


@pytest.mark.parametrize(
    ("rule", "value", "valid", "report"),
    [
        (ContentLength(field="f", min_length=5, max_length=15), "good length", True, "good length | 11"),
        (ContentLength(field="f", min_length=5), "test", False, "test | 4"),
        (ContentLength(field="f"), "x" * 51, True, "x" * 50 + "..."),
        (Regex(field="f", pattern=r"^\d{4}$"), "2020", True, "2020"),
        (Regex(field="f", pattern=r"^\d{4}$"), "2020\n", False, "2020\n"),
        (Regex(field="f", pattern="a|ab"), "ab", True, "ab"),
        (ControlledValue(field="f", values=["En"]), "en", False, "en"),
        (YearRange(field="f", current_year=2024), "2024-01", True, "2024-01"),
        (YearRange(field="f", lower=100, upper=2, current_year=2024), "1923", False, "1923"),
        (YearRange(field="f", lower=100, upper=2, current_year=2024), "", False, "NULL or Empty"),
        (YearRange(field="f", lower=100, upper=2, current_year=2024), "around 2020", False, "around 2020"),
        (validators.UrlSyntax(field="f"), "http://host/path", True, "http://host/path"),
        (validators.UrlSyntax(field="f"), "no url", False, "no url"),
    ],
)
def test_predicates(spark, rule, value, valid, report):
    detail = record(spark, f=[value]).select(rule.details(lambda name: F.col(name)).alias("d")).first()["d"][0]
    assert (detail["is_valid"], detail["value"]) == (valid, report)


def test_no_occurrences_are_a_detail_row(spark):
    rule = ControlledValue(rule_id=4, field="f", values=["a"], mandatory=True)
    row = validate(record(spark, f=[]), [rule], details=True).first()
    assert not row["rule_4"] and not row["is_valid"] and [(d["rule_id"], d["is_valid"], d["value"]) for d in row["details"]] == [(4, False, "no_occurrences_found")]


def test_record_verdict_counts_mandatory_rules_alone(spark):
    rules = [ControlledValue(rule_id=1, field="f", values=["a"], mandatory=True), ControlledValue(rule_id=2, field="absent", values=["b"])]
    row = validate(record(spark, f=["a"]), rules).first()
    assert row["is_valid"] and row["rule_1"] and not row["rule_2"]
    assert validate(record(spark, f=[]), []).first()["is_valid"]


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("NOT type=='article'", True),
        ("(type=='article' AND lang=='en') OR rights=='open'", True),
        ("type=='book' AND NOT lang=='en' OR rights=='closed'", True),
        ("type=='book' AND lang=='en' OR rights=='open'", True),
        ("NOT NOT type=='book'", True),
        ("type=%'b.*k'", True),
        ("type=%'b'", False),
        ("a==b", False),
        ("type=='book' AND", False),
        ("(type=='book'", False),
        ("NOT(type=='article')", False),
        ("type=%'['", False),
        ("", False),
    ],
)
def test_expressions(spark, expression, expected):
    df = record(spark, type=["book"], lang=["fr"], rights=["open"])
    assert df.select(compile_expression(expression, lambda name: fields.field(df, name)).alias("v")).first()["v"] is expected


def run(spark, rule, **values):
    out = t.transform(record(spark, **values), [rule]).first()
    return {k: out[k] for k in values}, out["is_transformed"]


T = dict(test_field="f", write_field="f")


@pytest.mark.parametrize(
    ("rule", "before", "after", "changed"),
    [
        (t.PriorityTranslate(translations=[["article", "Article"]], **T), ["article", "article"], ["article", "Article"], True),
        (t.PriorityTranslate(translations=[["a", "A"], ["b", "A"], ["A", "Z"]], **T), ["a", "b", "a", " ", "c"], ["b", "a", " ", "c", "Z"], True),
        (t.PriorityTranslate(translations=[["a", "A"], ["b", "B"]], replace_all=False, **T), ["b", "a"], ["b", "A"], True),
        (t.PriorityTranslate(translations=[["a", "A"]], replace=False, as_prefix=True, **T), ["abc"], ["abc", "A"], True),
        (t.PriorityTranslate(translations=[["x", "A"]], **T), ["a"], ["a"], False),
        (t.Translate(dictionary={"Article": "X"}, **T), ["ARTICLE"], ["X"], True),
        (t.Translate(dictionary={"art": "1", "arti": "2"}, as_prefix=True, **T), ["article"], ["1", "2"], True),
        (t.Translate(dictionary={"a": "b"}, **T), ["a", "b"], ["a", "b"], False),
        (t.Translate(dictionary={"a": "b", "b": "c"}, **T), ["a"], ["b"], True),
        (t.RemoveWhitespace(field="f"), ["a b\tc"], ["abc"], True),
        (t.RegexTranslate(source="f", target="f", pattern="test", replacement="TEST", remove_matching=False), ["test test test"], ["test test test", "TEST test test"], True),
        (t.RegexTranslate(source="f", target="f", pattern=r"\s+", replacement=""), ["Computer Science", "Data Science"], ["ComputerScience", "DataScience"], True),
        (t.RegexTranslate(source="f", target="f", pattern=r"(\w)(\w)\2", replacement="<$2$1>"), ["xabbc"], ["x<ba>c"], True),
        (t.RegexTranslate(source="f", target="f", pattern="z", replacement="y"), ["abc"], ["abc"], False),
        (t.RemoveDuplicates(field="f"), ["b", "a", "b", "c"], ["b", "a", "c"], True),
        (t.RemoveBlacklisted(field="f", values=["x"]), ["a", "x", "a"], ["a", "a"], True),
        (t.KeepFirst(field="f"), ["a", "b"], ["a"], True),
        (t.RemoveEmpty(field="f"), ["\t", "x", " ", "\x00"], ["x"], True),
        (t.BestOfVocabulary(field="f", vocabulary=["article", "book", "thesis"]), ["thesis", "article"], ["article"], True),
        (t.BestOfVocabulary(field="f", vocabulary=["article", "book", "thesis"]), ["report", "manual"], ["report", "manual"], False),
        (t.BestOfVocabulary(field="f", vocabulary=["a", "b"]), ["b", "x", "a", "a"], ["x", "a"], True),
        (t.FirstOfPrefix(field="f", prefix="instname:"), ["instname:A", "x", "instname:B"], ["instname:A", "x"], True),
        (t.ConditionalAdd(field="f", value="z", expression="f=='q'", remove_duplicates=True), ["a", "a"], ["a"], False),
        (t.ConditionalAdd(field="f", value="z", expression="f=='a'"), ["a"], ["a", "z"], True),
        (t.Normalize(field="f", validator=Regex(pattern="[a-z]")), ["a", "1", "a", "b"], ["a", "b"], True),
        (t.AddField(field="f", value="v"), [], ["v"], True),
        (t.AddField(field="f", value="v"), None, ["v"], True),
    ],
)
def test_transformers(spark, rule, before, after, changed):
    assert run(spark, rule, f=before) == ({"f": after}, changed)


def test_legacy_flag_of_priority_translate(spark):
    rule = t.PriorityTranslate(translations=[["a", "A"]], legacy_flag=True, **T)
    assert run(spark, rule, f=["a", "b"]) == ({"f": ["b", "A"]}, False)


def test_rename_moves_101_values_at_most(spark):
    values = [str(i) for i in range(150)]
    assert run(spark, t.Rename(source="f", target="g"), f=values, g=["x"]) == ({"f": values[101:], "g": ["x", *values[:101]]}, True)
    assert run(spark, t.BulkRename(pairs=[["f", "g"], ["g", "h"]]), f=values, g=["x"], h=[]) == ({"f": [], "g": [], "h": ["x", *values]}, True)
    assert run(spark, t.ConditionalRename(source="f", target="g", pattern="[0-9]{1,3}"), f=[*values, "z"], g=[]) == ({"f": [*values[101:], "z"], "g": values[:101]}, True)


def test_other_fields(spark):
    assert run(spark, t.ReduceHeavy(fields=["f", "absent"]), f=["a"], g=["b"]) == ({"f": [], "g": ["b"]}, True)
    df = spark.createDataFrame([(["reponame:Old", "x"], "New", None)], "f array<string>, name string, institution string")
    names = [["f", "reponame:", "name"]]
    assert t.transform(df, [t.AppendNames(names=names)]).first()["f"] == ["reponame:Old", "x"]
    assert t.transform(df, [t.AppendNames(names=names, replace=True)]).first()["f"] == ["x", "reponame:New"]
    assert t.transform(df, [t.AppendNames(names=[["f", "acr:", "institution"]])]).first()["f"][-1] == "acr:null"


def test_rules_run_in_order_on_each_others_results(spark):
    rules = [t.KeepFirst(field="f", run_order=3), t.RemoveBlacklisted(field="f", values=["a"], run_order=1), t.AddField(field="f", value="z", run_order=2)]
    assert t.transform(record(spark, f=["a", "b", "c"]), rules).first()["f"] == ["b"]


def test_many_rules_in_a_chain(spark):
    rules = [t.AddField(field="f", value=str(i), run_order=i) for i in range(40)]
    assert t.transform(record(spark, f=[]), rules).first()["f"] == [str(i) for i in range(40)]


def test_rule_json():
    source = [{"type": "normalize", "field": "f", "run_order": 2, "validator": {"type": "regex", "pattern": "a"}}, {"type": "add_field", "field": "f", "value": "v", "run_order": 1}]
    rules = rules_from_json(t.TransformerRule, json.dumps(source), order="run_order")
    assert [r.type for r in rules] == ["add_field", "normalize"] and isinstance(rules[1].validator, Regex)
    assert rule_from_json(t.TransformerRule, rule_to_json(rules[1])) == rules[1]
    for bad in ({"type": "no such"}, {"type": "regex", "colour": 1}, {"type": "regex", "quantifier": "SOME"}):
        with pytest.raises(BadRule):
            rule_from_json(ValidatorRule, bad)
    with pytest.raises(BadRule):
        rule_from_json(t.TransformerRule, {"type": "add_field", "field": "f"})


def test_rule_schemas():
    out = schemas(ValidatorRule)
    assert out["content_length"]["properties"]["max_length"] == {"type": "integer", "title": "max length", "order": 8, "default": 2147483647}
    assert schemas(t.TransformerRule)["rename"]["required"] == ["source", "target"]


def test_controlled_table_and_url_checks(spark):
    occ = spark.createDataFrame([(1, "a"), (1, "z"), (2, None)], "record_id long, value string")
    vocabulary = spark.createDataFrame([("a",), ("a",)], "value string")
    assert sorted((r["record_id"], r["is_valid"]) for r in validators.mark_controlled(occ, vocabulary).collect()) == [(1, False), (1, True), (2, False)]
    urls = spark.createDataFrame([("http://a",), ("http://b",), ("junk",), (None,)], "url string")
    out = {r["url"]: r["url_status"] for r in validators.check_urls(urls, "url", lambda u: {"http://a": "OK"}[u]).collect()}
    assert out == {"http://a": "OK", "http://b": "UnknownError", "junk": "MalformedURL", None: "MalformedURL"}


XML = """<metadata xmlns="urn:x"><element name="dc"><element name="type"><element name="none"><field name="value">book</field><field name="value"></field><field name="value">map</field></element></element>
<element name="title"><field name="value">T</field><field name="language">en</field></element></element></metadata>"""


@pytest.mark.parametrize(
    ("address", "expected"), [("dc.type", []), ("dc.type.none", ["book", "map"]), ("dc.type.*", ["book", "map"]), ("dc.*", ["book", "map", "T"]), ("dc.title:language", ["en"]), ("dc.title", ["T"]), ("nothing", [])]
)
def test_field_addresses(spark, address, expected):
    df = spark.createDataFrame([(XML,)], "xml string")
    assert df.select(occurrences(F.col("xml"), address).alias("v")).first()["v"] == expected


def test_element_address():
    assert xpath_of("dc.subject.$") == "/*[local-name()='metadata']/*[local-name()='element' and @name='dc']/*[local-name()='element' and @name='subject']"
    assert xpath_of("").endswith("/*[local-name()='field' and @name='value']")


def test_occurrence_rows(spark):
    df = record(spark, **{"dc.type": ["b", "a", "b"], "dc.title": []})
    rows = fields.occurrences_from_records(df, ["dc.type", "dc.title"])
    assert [(r["field"], r["pos"], r["value"]) for r in rows.orderBy("pos").collect()] == [("dc.type", 0, "b"), ("dc.type", 1, "a"), ("dc.type", 2, "b")]
    assert fields.records_from_occurrences(rows, ["dc.type", "dc.title"]).first().asDict() == {"record_id": 1, "dc.type": ["b", "a", "b"], "dc.title": []}
