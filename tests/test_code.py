"""Definitions of languages with braces."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.code import BRACED, brace_sections, tokens
from tessera.sources import extract

JAVA = '''package a.b;
import x.Y;

/** Doc { of } a class. */
@Deprecated
public final class A<T> extends B {
    char c = '{'; String s = "}\\"{"; // } no
    void run() { if (x) { y(); } }
}

enum E { ONE, TWO }
'''
C = '''#include <stdio.h>
#define X 1
static int twice(int x)
{
    /* } */ return 2 * x;
}

struct point { int x; int y; };
int total = 0;
int table[] = { 1, 2 };
int main(void) { return twice('}'); }
'''
GO = '''package main

import "fmt"

type P struct {
	X int
}

func (p P) Show() string {
	return fmt.Sprintf(`{ %d "`, p.X)
}

var a, b = 1, 2
func main() {}
'''
JS = '''import x from "x";
const y = { a: 1 };
let z = 'it\\'s }';

export class A {
  m() { return `}{`; }
}
function f(a, b = {}) {
  return a;
}
// the end
f(1);
'''
RUST = '''use std::fmt;
#[derive(Debug)]
pub struct S<'a> { x: &'a str }

impl<'a> fmt::Display for S<'a> {
    fn fmt(&self) -> char { '}' }
}
pub(crate) fn go() -> u8 { 1 }
const N: usize = 3;
'''
CASES = [
    (JAVA, True, ["package a.b;\nimport x.Y;\n/** Doc { of } a class. */", "@Deprecated\npublic final class A<T>", "enum E { ONE, TWO }"]),
    (C, True, ["#include <stdio.h>\n#define X 1", "static int twice(int x)\n{", "struct point { int x; int y; };", "int total = 0;\nint table[] = { 1, 2 };", "int main(void) {"]),
    (GO, False, ['package main\nimport "fmt"', "type P struct {", "func (p P) Show() string {", "var a, b = 1, 2", "func main() {}"]),
    (JS, False, ['import x from "x";\nconst y = { a: 1 };\nlet z = ', "export class A {", "function f(a, b = {}) {", "// the end\nf(1);"]),
    (RUST, True, ["use std::fmt;", "#[derive(Debug)]\npub struct S<'a> {", "impl<'a> fmt::Display", "pub(crate) fn go()", "const N: usize = 3;"]),
    ("", True, []),
    ("class A { void f() {", True, ["class A { void f() {"]),
    ("}} int x;\nclass B {}", True, ["}", "class B {}"]),
]


@pytest.mark.parametrize("source,characters,begins", CASES)
def test_definitions(spark, source, characters, begins):
    row = spark.createDataFrame([(source, characters)], "t string, c boolean")
    made = row.select(tokens(F.col("t"), F.col("c")).alias("tokens"), brace_sections(F.col("t"), F.col("c")).alias("s")).first()
    assert "".join(made["tokens"]) == source
    assert len(made["s"]) == len(begins) and all(s.startswith(b) for s, b in zip(made["s"], begins)), made["s"]
    assert "".join("".join(made["s"]).split()) == "".join(source.split())


def test_code_files_in_the_jvm(spark):
    files = [("/w/A.java", JAVA.encode()), ("/w/m.go", GO.encode()), ("/w/p.py", b"import a\n\ndef f():\n    return 1\n"), ("/w/e.js", b" \n"), ("/w/s.sh", b"a\n\nb")]
    rows = extract.extract_pages(spark.createDataFrame(files, "path string, content binary")).orderBy("document_name", "page_number").collect()
    assert {r["page_type"] for r in rows} == {"code"} and ".java" in BRACED
    assert {n: sum(r["document_name"] == n for r in rows) for n in ("A.java", "m.go", "p.py", "e.js", "s.sh")} == {"A.java": 3, "m.go": 5, "p.py": 2, "e.js": 0, "s.sh": 2}
    assert [r["total_pages"] for r in rows if r["document_name"] == "m.go"] == [5] * 5


def test_a_long_source(spark):
    source = "".join(f"int f{k}(int x) {{\n  return x + {k}; // {{\n}}\n" for k in range(1500)) + '"' + "\\\\" * 20000 + '"'
    row = spark.createDataFrame([(source,)], "t string")
    assert row.select(F.size(brace_sections(F.col("t"), F.lit(True)))).first()[0] == 1501
