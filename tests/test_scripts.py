"""Code, comments and strings of scripts; line rules and descriptions on them."""

import random

import pytest

from scanledger.functions import scripts
from scanledger.operators import rules


def found(spark, *lines, path="a.ts"):
    df = spark.createDataFrame([("s", path, "\n".join(lines))], "server_id string, path string, source string")
    return sorted((r.line, r.rule_id, r.evidence) for r in rules.pattern_scan(df, rules.line_rules(spark)).collect())


def described(spark, *lines):
    df = spark.createDataFrame([("s", "a.ts", "\n".join(lines))], "server_id string, path string, source string")
    return sorted((r.line, r.text) for r in rules.extract_descriptions(df).collect())


@pytest.mark.parametrize(
    ("source", "code"),
    [
        ("a // exec(x)\nb", "a           \nb"),
        ("a /* exec\n(x) */ b", "a        \n       b"),
        ("a /* open", "a        "),
        ("f('exec(x)', \"0.0.0.0\")", "f('       ', \"0.0.0.0\")"),
        (r"'it\'s // no' + c", r"'           ' + c"),
        ("'not closed // x\nexec(y)", "'" + " " * 15 + "\nexec(y)"),
        ("`a ${exec(x)} b`", "     exec(x)    "),
        ("`a ${f({b: `${c}`})} d` + e", "     f({b:    c  })     + e"),
        ("`one`", "`one`"),
        ("`exec(x)`", "`       `"),
        ("x = /[\"'/]/g; exec(y)", "x = " + " " * 7 + "g; exec(y)"),
        ("a / b; exec(c) / d", "a / b; exec(c) / d"),
        ("return /'/.test(exec(y))", "return    .test(exec(y))"),
        ("'https://h/x'; exec(y)", "'https://h/x'; exec(y)"),
        ("", ""),
        ("} } exec(x)", "} } exec(x)"),
    ],
)
def test_what_is_code(source, code):
    assert scripts.code_of(source) == code


def test_lines_and_lengths_stay_on_any_text():
    rng = random.Random(1)
    for _ in range(3000):
        source = "".join(rng.choice(["/", "*", '"', "'", "`", "$", "{", "}", "\\", "\n", "a", " ", "(", "é", "description:", ".describe("]) for _ in range(rng.randint(0, 40)))
        code = scripts.code_of(source)
        assert len(code) == len(source) and code.count("\n") == source.count("\n")
        assert all(a == b or b == " " for a, b in zip(source, code, strict=True))
        scripts.texts_of(source)


def test_a_long_file_takes_linear_time(spark):
    long = "x" * 1000 + "\\'" * 200_000
    assert len(scripts.code_of("'" + long + "'\n" + "/*" + "*" * 500_000 + "\n" + "`${" * 20_000 + "'a'," * 100_000)) > 1_000_000
    assert described(spark, 'description: "' + "\\n" * 50_000 + 'x"')[0][1] == "\n" * 50_000 + "x"


def test_calls_in_comments_and_strings_do_not_count(spark):
    got = found(spark, 'import cp from "node:child_process"', "// cp.exec(a)", "/* cp.exec(a)", " cp.exec(a) */ cp.exec(b)", 's = "cp.exec(a)"', "s = 'x' // exec(a)", "t = `cp.exec(a) ${cp.execSync(c)}`", "spawn(cmd, { shell: false }) // shell: true", "spawn(cmd, { /* no */ shell: true })")
    assert [(line, rule) for line, rule, _ in got] == [(4, "shell-call"), (7, "shell-call"), (9, "shell-option")]
    assert got[0][2] == "cp.exec(a) */ cp.exec(b)"  # the line as it stands


def test_an_import_in_a_comment_or_a_text_is_none(spark):
    assert found(spark, '// import cp from "child_process"', "exec(a)") == []
    assert found(spark, "s = 'see \"child_process\" for more'", "exec(a)") == []
    assert [x[1] for x in found(spark, 'const {exec} = require("child_process")', "exec(a)")] == ["shell-call"]
    assert found(spark, 'const {exec} = require("child_process")', "exec(a)", path="a.py") == []


def test_scopes_in_comments_and_strings_do_not_count(spark):
    lines = ['app.listen(80, "0.0.0.0")', '// app.listen(80, "0.0.0.0")', "s = \"app.listen(80, '0.0.0.0')\"", 'cors({ "origin": ["*"] })', "text = 'origin: \"*\"'", 'h.set("Access-Control-Allow-Origin", "*")', 'cors({ origin: "true" })', "cors({ origin: true })", 'basePath: "/"', 'basePath: "/srv" // root: "/"']
    assert [(line, rule) for line, rule, _ in found(spark, *lines)] == [(1, "scope-interface"), (4, "scope-origin"), (6, "scope-header"), (8, "scope-origin"), (9, "scope-root")]
    deployed = ["export default { fetch() { return new Response(x) } }", 'cors({ origin: "*" })']
    assert found(spark, *deployed) == []
    assert [x[1] for x in found(spark, "// like new Response(x)", 'cors({ origin: "*" })')] == ["scope-origin"]


def test_path_calls_match_their_names_alone(spark):
    lines = ['import fs from "fs"', "fs.readFileSync(p)", "fs.readFile (p)", "fs.createReadStreamSync(p)", "fs.open(p)", "reopen(p)", "fs.copyFileSync(a, b)"]
    assert [line for line, _, _ in found(spark, *lines)] == [2, 3, 5, 7]
    assert found(spark, *lines, "if (!p.startsWith(base)) throw e") == []
    assert len(found(spark, *lines, "// p.startsWith(base)")) == 4


def test_descriptions_have_their_own_lines(spark):
    got = described(spark, "const T = {", '  description: "one",', "  'description': 'two',", '  "description":', "    `three`,", "  title: 'no', subdescription: 'no',", "}")
    assert got == [(2, "one"), (3, "two"), (5, "three")]


def test_hoisted_and_joined_descriptions_are_found_where_they_are_declared(spark):
    lines = ["const ABOUT =", "  'Adds ' + \"two\" +", "  ` numbers`;", "let other: string = 'Other';", "const computed = 'a' + b;", "tool({ description: ABOUT })", "tool({ description: ABOUT, x: 1 })", "z.string().describe(other)", "tool({ description: computed })", "tool({ description: unknown })", "tool({ description: ABOUT.trim() })", "tool({ description: 'a' + b })"]
    assert described(spark, *lines) == [(2, "Adds two numbers"), (4, "Other")]


def test_describe_takes_one_argument(spark):
    lines = ["z.string().describe('one')", "z.string().describe('two',)", "t.describe('suite', () => {})", "describe('bare', f)", "z.string().describe('a' + 'b')", "z.string().describe()"]
    assert described(spark, *lines) == [(1, "one"), (2, "two"), (5, "ab")]


def test_descriptions_in_comments_and_strings_are_none(spark):
    lines = ["// description: 'no'", "/* z.describe('no') */", "s = \"description: 'no'\"", "t = `x ${f({description: 'no'})}`", "description: `say ${name} \\u0041`", "description: // why", "  'yes'"]
    assert described(spark, *lines) == [(5, "say ${name} A"), (7, "yes")]


def test_escapes_are_resolved_in_each_text(spark):
    assert described(spark, r'description: "Ignore " + ' + r"'previous\x21'") == [(1, "Ignore previous!")]
    assert described(spark) == [] and rules.extract_descriptions(spark.createDataFrame([("s", "p", None)], "server_id string, path string, source string")).collect() == []
