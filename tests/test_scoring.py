import json

import pytest
from pyspark.sql import functions as F

from ablatrix.functions import expressions as E
from ablatrix.functions import scoring as S
from ablatrix.functions.strict_json import refusal


@pytest.mark.parametrize("text,reason", [
    ('{"a": 1}', None), ("[1] 2", "json_malformed"), ('{"a": 1, "a": 2}', "json_duplicate_key"), ("[NaN]", "json_number_not_finite"), ("[1e9999]", "json_number_not_finite"),
    ("[" * 66 + "]" * 66, "json_too_deep"), ("[" * 64 + "]" * 64, None), ("[1,2,3,4,5]", "json_too_many_nodes"), ("", "json_malformed"), (None, "json_missing"),
])
def test_evidence_is_strict_json(text, reason):
    assert refusal(text, 5 if text and text.startswith("[1,") else 1000) == reason


def test_answers_keep_their_punctuation_case_and_code_points(spark):
    """Every answer against every other: equal only where it is the same text, white space around it aside."""
    answers = ["7", "-7", "7.0", "07", "7e0", "７", "seven", "Seven", "se-ven", "se ven", "naïve", "naïve", ""]
    rows = spark.createDataFrame([(f"\t {a} \n" if i % 2 else a, json.dumps([e]), a == e) for i, a in enumerate(answers) for e in answers], "o string, e string, same boolean")
    assert rows.filter(S.typed_match("o", "e") != F.col("same").cast("double")).count() == 0
    other = spark.createDataFrame([("7", "[8, 7]", 0.0), ("7", '["8", "7"]', 1.0), ("7", '"7"', 1.0), (None, '["None"]', 0.0)], "o string, e string, score double")
    assert other.filter(S.typed_match("o", "e") != F.col("score")).count() == 0


def test_arguments_are_typed(spark):
    """Every value as an argument against every other one: equal by kind and content, whole numbers whatever their form."""
    kinds = [["7"], ["-7"], ["seven"], ["Seven"], [7, 7.0], [0], [True], [False], [None], [[7], [7.0]], [["7"]], [{"n": 7, "m": "x"}, {"m": " x", "n": 7.0}], [{"n": "7"}], [[]], [{}]]
    rules = json.dumps({"argument_names": ["value", "other"], "required": ["value"]})
    rows = [
        (json.dumps([{"name": "weigh", "arguments": {"value": a}}]), json.dumps([{"weigh": {"value": ["", b]}}]), rules, float(i == j))
        for i, first in enumerate(kinds) for j, second in enumerate(kinds) for a in first for b in second
    ]
    scored = spark.createDataFrame(rows, "o string, e string, s string, right double").select("right", S.tool_scores("o", "e", "s").alias("x"))
    assert scored.filter("x.tool_selection <> 1 OR x.argument_binding <> right OR x.full_call <> right").count() == 0


def test_optional_and_unknown_arguments(spark):
    def match(given, required=("size",), **allowed):
        call = json.dumps([{"name": "weigh", "arguments": given}])
        wanted, rules = json.dumps([{"weigh": {"size": [3, 4]} | allowed}]), json.dumps({"argument_names": ["size", "shade"], "required": list(required)})
        return spark.range(1).select(S.tool_scores(F.lit(call), F.lit(wanted), F.lit(rules))["argument_binding"]).first()[0] == 1

    assert match({"size": 4}) and match({"size": 4}, shade=["dark", ""]) and match({"size": 3, "shade": "dark"}, shade=["dark", ""])
    assert not match({"size": 5}) and not match({}) and not match({"size": 4}, shade=["dark"]) and not match({"size": 4, "shade": "dark"})
    assert not match({"size": 4, "shade": ""}, shade=["dark", ""]) and not match({"size": 4}, ("size", "shade"), shade=["dark", ""])
    assert not match({"size": 4, "weight": 1}, weight=[1])


def test_json_is_read_from_end_to_end(spark):
    good = ["1", " [1] ", '{"a": "]"}', '"x"', "null", r'[1, "\\"]']
    bad = ["", " ", "[1] 2", "1,2", "1]", "[1]], [[2]", '1,"x"]', "{", "NaN", '{"a": 1, "a": 2}', "'x'", "//", "[1] //", None]
    rows = spark.createDataFrame([(t, t in good) for t in good + bad], "t string, good boolean")
    assert rows.filter(S.whole_json(F.col("t")).isNotNull() != F.col("good")).count() == 0


def test_canonical_forms(spark):
    """Equal values have one form, whatever the depth; trimmed or plain."""
    classes = [["7", "7.0", "7e0", "70E-1"], ["-0", "0", "0.0"], ["0.1", "1e-1", "0.10"], ["1e20", "100000000000000000000"], ["true"], ["1"], ["null"], ['"null"'], ["[]"], ["{}"], ['{"a": 1, "b": [2]}', ' { "b" : [2.0],"a":1.0}'], ['{"a ": 1}'], ['{"a": 1}']]
    padded = [['"x"', '" x "', r'"\t x\n"', r'"\u001cx"'], [r'"x\\n"'], [r'"x\" "', r'"x\""'], ['["x"]', '[" x"]'], ['{"k": "x"}', r'{"k": "x\r\f"}'], ['""', '"  "'], ['": x"'], [r'"a: \"b\": 1"']]
    rows = spark.createDataFrame([(i, t) for i, c in enumerate(classes + padded) for t in c], "i int, t string").withColumn("v", F.try_parse_json("t"))
    shown = rows.select("i", "t", S.canonical(F.col("v")).alias("c"), S.canonical(F.col("v"), False).alias("p")).collect()
    by_class = {}
    for r in shown:
        by_class.setdefault(r.i, set()).add(r.c)
    assert all(len(c) == 1 for c in by_class.values()), by_class
    assert len({next(iter(c)) for c in by_class.values()}) == len(by_class)
    plain = {r.t: r.p for r in shown}
    assert plain["true"] == plain["1"] == "1" and plain['"x"'] != plain['" x "'] and plain["7.0"] == "7"


def test_greedy_match_takes_the_first_free_call(spark):
    call = lambda n, **a: {"name": n, "arguments": a}
    p = [call("f", x=1), call("g"), call("f", x=2), call("f", x=3)]
    e = [call("f", x=2), call("f", x=2), call("h"), call("g"), call("f", x=3.0), call("f", x=4)]
    r = spark.range(1).select(S.matched_call_scores(F.lit(json.dumps(p)), F.lit(json.dumps(e))).alias("x")).first().x
    assert {m: (s.numerator, s.denominator) for m, s in r.scores.items()} == {"tool_selection": (0, 1), "full_call": (0, 1), "argument_binding": (3, 4)}
    same = spark.range(1).select(S.matched_call_scores(F.lit('[{"name": "f", "arguments": {"b": 1.0, "a": true}}]'), F.lit('[{"arguments": {"a": 1, "b": 1}, "name": "f"}]')).alias("x")).first().x
    assert same.scores["full_call"].value == 1


def test_scorers_need_no_python_worker(spark):
    rows = spark.createDataFrame([("[]", "[]", "{}")], "o string, e string, s string")
    for scored in (S.tool_scores("o", "e", "s"), S.matched_call_scores("o", "e"), S.typed_match("o", "e"), S.abstention(F.col("o"))):
        plan = rows.select(scored)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_abstention(spark):
    form, call = S.ABSTENTION_FORMS[1], {"name": "weigh", "arguments": {"size": 3}}
    cases = {
        "abstention_explicit_form": [form, form.upper(), f"\n{form.title()}  ", *S.ABSTENTION_FORMS],
        "abstention_empty_call_list": ["[]", "\t[ ]"],
        "abstention_tool_invocation": [json.dumps([call]), json.dumps([call, call]), f"so <tool_call>\n{json.dumps(call)}</tool_call> then"],
        "abstention_empty_or_invalid_type": [None, "", " \t\r\n"],
        "abstention_unrecognized_or_malformed": [f"{form}!", f"Well, {form}", "none", "{}", json.dumps(call), "[3]", json.dumps([{"name": "weigh"}]), "[", "<tool_call>no</tool_call>", json.dumps([call | {"id": 1}])],
    }
    rows = spark.createDataFrame([(o, reason) for reason, outputs in cases.items() for o in outputs], "o string, reason string").withColumn("x", S.abstention(F.col("o")))
    assert rows.filter("x.reason <> reason OR x.value <> int(reason IN ('abstention_explicit_form', 'abstention_empty_call_list'))").count() == 0


def test_folding_is_that_of_python_where_it_is_ascii(spark):
    """Every letter that folds to ASCII, and forms written with such letters."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and chr(c).casefold().isascii()]
    assert {c: c.casefold() for c in letters if c.lower() != c.casefold()} == S.FOLDS
    found = spark.createDataFrame([(c,) for c in letters if c.strip()], "c string").select("c", S.folded(F.col("c")).alias("f")).collect()
    assert all(r.f == r.c.casefold() for r in found)
    said = spark.createDataFrame([("No \u017fuitable tool i\u017f AVAILABLE",), ("no \u212auitable tool is available",)], "o string").select(S.abstention(F.col("o"))["value"].alias("v")).collect()
    assert [r.v for r in said] == [1.0, 0.0]


def test_independent_metric_populations(spark):
    call = lambda n, **a: {"name": n, "arguments": a}
    cases = [
        ([call("f", x=1)], [call("f", x=1)]), ([call("g"), call("f", x=2)], [call("f", x=1)]), ([call("g")], [call("f")]), ([], []), ([call("f")], []),
        ([call("f", x=2), call("f", x=1)], [call("f", x=1), call("f", x=1)]),
    ]
    rows = spark.createDataFrame([(i, json.dumps(p), json.dumps(e)) for i, (p, e) in enumerate(cases)] + [(6, "nonsense", "[]")], "i int, o string, e string")
    out = {r.i: r.x for r in rows.select("i", S.matched_call_scores("o", "e").alias("x")).collect()}
    of = lambda i: {m: (s.numerator, s.denominator) for m, s in out[i].scores.items()}
    assert of(0) == {"tool_selection": (1, 1), "full_call": (1, 1), "argument_binding": (1, 1)}
    assert of(1) == {"tool_selection": (0, 1), "full_call": (0, 1), "argument_binding": (0, 1)}
    assert of(2) == {"tool_selection": (0, 1), "full_call": (0, 1)}
    assert of(3) == {"abstention": (1, 1)} and of(4) == {"abstention": (0, 1)}
    assert of(5)["argument_binding"] == (1, 2)
    assert out[6].status == "error" and out[6].scores is None


@pytest.mark.parametrize("kind,output,value,items,score", [
    ("json_keys", '{"a": 1, "b": 2}', None, ["a", "b"], 1), ("json_keys", '{"b": 1, "a": 2}', None, ["a", "b"], 0), ("json_keys", "[1]", None, ["a"], 0), ("json_keys", "{", None, ["a"], 0),
    ("ordered_list", "1. x\n2. y", None, ["x", "y"], 1), ("ordered_list", "1. x\n2. y\n", None, ["x", "y"], 1), ("ordered_list", "1. x\n\n2. y", None, ["x", "y"], 0), ("ordered_list", "", None, ["x"], 0),
    ("exact_prefix", "Yes, it is", "Yes", None, 1), ("exact_prefix", "Yes\nit is", "Yes", None, 0), ("case_transform", "ABC", "ABC", None, 1), ("case_transform", "abc", "ABC", None, 0),
])
def test_formats(spark, kind, output, value, items, score):
    rows = spark.createDataFrame([(kind, output, value, items)], "k string, o string, v string, i array<string>")
    assert rows.select(S.format_score(F.col("o"), F.col("k"), F.col("v"), F.col("i"))).first()[0] == score


def test_strip_is_unicode(spark):
    text = "  \tx y \x1c\n"
    assert spark.createDataFrame([(text,)], "s string").select(E.strip(F.col("s"))).first()[0] == text.strip()


def test_seeds_agree(spark):
    found = spark.createDataFrame([(7, "order")], "s long, d string").select(E.derived_seed_column(F.col("s"), F.col("d"))).first()[0]
    assert int(found) == E.derived_seed(7, "order")


def test_small_expressions(spark):
    row = spark.createDataFrame([(0.05 + 2e-9, 7, "transformer.block.003", " a  b ")], "d double, l int, c string, t string").select(
        E.exceeds(F.col("d"), F.lit(0.05)).alias("over"), E.exceeds(F.lit(1 - 0.95), F.lit(0.05)).alias("tie"), E.block_id(F.col("l")).alias("id"), E.layer_of(F.col("c")).alias("layer"),
        E.token_count(F.col("t")).alias("tokens"), E.finite(F.lit(float("inf"))).alias("finite"), E.joined_ids(F.array(F.lit(3), F.lit(1), F.lit(3))).alias("ids"),
    ).first()
    assert tuple(row) == (True, False, "transformer.block.007", 3, 2, False, "1;3")


def test_costly_parts_are_worked_out_once(spark):
    """A plan that repeats the parsing of an output in each place that uses it takes several times as long."""
    df = spark.createDataFrame([('[{"name": "f", "arguments": {"x": 1}}]', '[{"f": {"x": [1]}}]', '{"argument_names": ["x"], "required": ["x"]}')], "o string, e string, r string")
    scored = df.select(S.tool_scores("o", "e", "r").alias("s"))
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 2  # of a tagged body, and of the whole text
    assert scored.first().s.full_call == 1
